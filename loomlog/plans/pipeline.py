"""Pipelines from plain dictionaries: chunks, frames or records in, log rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomlog.functions import text as T
from loomlog.operators import lines as L
from loomlog.operators import order, signals
from loomlog.storage import materialize, passing
from loomlog.streaming.stateful import split_lines_stream

#: A step takes a column and its options; ``reads`` and ``gives`` are ``bytes`` or ``text``.
STEPS: dict[str, tuple[Callable[..., Column], str, str]] = {}


def register_step(name: str, reads: str = "text", gives: str = "text"):
    """Decorator that adds a column function as a step; a name counts once, whatever its case. Pandas UDFs work, but slowly."""

    def put(function: Callable[..., Column]) -> Callable[..., Column]:
        if name.lower() in STEPS:
            raise ValueError(f"step {name!r} is registered already")
        STEPS[name.lower()] = (function, reads, gives)
        return function

    return put


for _name, _function, _reads, _gives in (
    ("printable", T.printable, "bytes", "bytes"), ("decode", T.decode_bytes, "bytes", "text"), ("ansi_filter", T.ansi_filter, "text", "text"), ("regex_replace", T.regex_replace, "text", "text"),
    ("replace", T.string_replace, "text", "text"), ("whitespace", T.whitespace_normalize, "text", "text"), ("strip", T.strip, "text", "text"), ("path", T.path_normalize, "text", "text"),
    ("fixed_width", T.fixed_width_normalize, "text", "text"),
):
    register_step(_name, _reads, _gives)(_function)


def transform_steps(column: Column, steps: list[dict], reads: str = "text") -> Column:
    """The steps one after another; types must fit. ``steps``: dictionaries with ``step`` and its options."""
    for spec in steps:
        options = dict(spec)
        name = options.pop("step").lower()
        if name not in STEPS:
            raise ValueError(f"unknown step {name!r}; known: {', '.join(sorted(STEPS))}")
        function, takes, gives = STEPS[name]
        if takes != reads:
            raise TypeError(f"step {name!r} reads {takes}, but gets {reads}")
        column, reads = function(column, **options), gives
    if reads != "text":
        raise TypeError("the steps do not end in text")
    return column


#: The presets and their defaults.
PRESETS = {
    "default": {"kind": "text", "split": 10, "printable": None, "decode": {"encoding": "ascii", "errors": "replace"}, "steps": [], "parse": None},
    "serial_default": {"kind": "text", "split": 10, "printable": {"allow_escape": True}, "decode": {"encoding": "ascii", "errors": "replace"}, "steps": [{"step": "ansi_filter"}], "parse": {"message_index": 0}},
    "records": {"kind": "records"},
    "cantools": {"kind": "frames", "unmapped_policy": "report", "prepend_msg_name": False},
    "key_value": {"kind": "key_value"},
}


def build_pipeline(spec: dict) -> Callable[..., DataFrame]:
    """A function from an input table to log rows. ``spec``: ``type`` (a preset), ``device``, and options over the preset's.

    Frames need a ``signal_dict`` table in the spec. A line that cleaning, decoding or the steps leave empty is dropped. Chunks may be a stream; lines that run over
    chunks are then state of their source (see ``loomlog.streaming.stateful``).
    """
    options = dict(spec)
    name = str(options.pop("type", "default")).lower()
    if name not in PRESETS:
        raise ValueError(f"unknown pipeline {name!r}; known: {', '.join(sorted(PRESETS))}")
    unknown = set(options) - set(PRESETS[name]) - {"device", "ignore_invalid", "signal_dict"}
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    own = {"ignore_invalid": False} | PRESETS[name] | options
    device = own["device"].lower()

    def split(chunks: DataFrame) -> DataFrame:
        if own["split"] is None:
            return chunks.withColumnsRenamed({"payload": "raw", "chunk_seq": "line_no"})
        return (split_lines_stream if chunks.isStreaming else L.split_lines)(chunks, own["split"])

    def text(chunks: DataFrame) -> DataFrame:
        rows = split(chunks)
        keep = [F.col(c) for c in rows.columns if c not in ("line", "_bad")]
        clean = F.col("raw") if own["printable"] is None else T.printable(F.col("raw"), **own["printable"])
        rows = rows.withColumn("_clean", clean).withColumn("_text", T.decode_bytes(F.col("_clean"), **own["decode"])).withColumn("_final", transform_steps(F.col("_text"), own["steps"]))
        plain = F.coalesce("_final", T.decode_bytes(F.col("raw"), "ascii"))
        left = (F.octet_length("_clean") > 0) & F.coalesce(F.col("_text") != "", F.lit(True)) & (plain != "")
        rows = rows.select(*keep, F.inline(F.array(F.struct(F.when(left, plain).alias("line"), F.col("_final").isNull().alias("_bad"))))).where("line is not null")
        parsed = L.default_rows(rows, device).withColumn("_error", F.lit(None).cast("string")) if own["parse"] is None else L.parse_line(rows, device, **own["parse"])
        parsed = parsed.withColumn("_error", F.coalesce("_error", F.when(F.col("_bad"), F.col("message")))).drop("_bad", "raw")
        return L.route_errors(parsed, own["ignore_invalid"])

    def records(rows: DataFrame) -> DataFrame:
        return L.route_errors(L.records_to_logs(rows, device), own["ignore_invalid"])

    def frames(rows: DataFrame) -> DataFrame:
        decoded = signals.decode_signals(rows, own["signal_dict"], own["unmapped_policy"])
        return L.route_errors(signals.signals_to_logs(decoded, device, own["prepend_msg_name"]), own["ignore_invalid"])

    def key_value(rows: DataFrame) -> DataFrame:
        return L.extract_key_values(rows, device)

    return {"text": text, "records": records, "frames": frames, "key_value": key_value}[own["kind"]]


#: What tells rows apart in one order, as far as inputs have it.
PLACES = ("source", "chunk_seq", "frame_seq", "line_no", "kv_pos")


def run_topology(spec: dict[str, dict], inputs: dict[str, DataFrame], order_cols: tuple[str, ...] | None = None) -> DataFrame:
    """Runs several pipelines and merges their rows in one order with ``seq``.

    ``spec``: name -> pipeline spec with ``sources``, a list of inputs or of pipelines named before (a key-value pipeline reads those; what is
    read again is written once). Rows go by time, then by their place in the input (``PLACES``), then by device, module, level and message, or by
    ``order_cols``, which must tell all rows apart for ``seq`` to be the same on every run.
    """
    _check_sources(spec, inputs)
    done: dict[str, DataFrame] = {}
    read_again = {s for one in spec.values() for s in one["sources"]}
    for name, one in spec.items():
        own = dict(one)
        parts = [done.get(s, inputs.get(s)) for s in own.pop("sources")]
        out = build_pipeline(own)(order.merge_logs(*parts))
        done[name] = materialize(out, "pipeline") if name in read_again else out
    merged, default_order = _merged(done)
    return order.assign_seq(merged, order_cols or default_order)


def _check_sources(spec: dict[str, dict], inputs: dict[str, DataFrame]) -> None:
    """Sources are inputs or pipelines named before."""
    known = set(inputs)
    for name, one in spec.items():
        missing = [s for s in one["sources"] if s not in known]
        if missing:
            raise ValueError(f"{name}: unknown sources {missing}")
        known.add(name)


def _merged(done: dict[str, DataFrame]) -> tuple[DataFrame, tuple[str, ...]]:
    """The rows of all pipelines with the places that some of them have, and the order by default."""
    columns = ["timestamp_ns", "device", "module", "level", "message"]
    places = [c for c in PLACES if any(c in x.columns for x in done.values())]
    merged = order.merge_logs(*[x.select(*columns, *[c for c in places if c in x.columns]) for x in done.values()])
    return merged, ("timestamp_ns", *places, "device", "module", "level", "message")


def stream_topology(spec: dict[str, dict], inputs: dict[str, DataFrame]) -> tuple[DataFrame, Callable[[DataFrame], dict[str, DataFrame]]]:
    """``run_topology`` over streams, in two parts: one stream, and what becomes of its batches.

    The stream holds the rows of every pipeline that reads an input, with the pipeline's name in ``_pipeline``; lines that run over chunks and batches are
    its state, kept once however many read the pipeline. The function takes a batch of it and gives the rows of all pipelines by name, those that read other pipelines too.
    A pipeline may read inputs and pipelines. Inputs may be streams or tables.
    """
    _check_sources(spec, inputs)
    own = {name: ({k: v for k, v in one.items() if k != "sources"}, [s for s in one["sources"] if s in inputs], [s for s in one["sources"] if s not in inputs]) for name, one in spec.items()}
    first = [build_pipeline(options)(order.merge_logs(*[inputs[s] for s in read])).withColumn("_pipeline", F.lit(name)) for name, (options, read, _) in own.items() if read]
    if not first:
        raise ValueError("no pipeline reads an input")

    def rest(batch: DataFrame) -> dict[str, DataFrame]:
        done: dict[str, DataFrame] = {}
        for name, (options, read, behind) in own.items():
            parts = [batch.where(F.col("_pipeline") == name).drop("_pipeline")] if read else []
            parts += [build_pipeline(options)(order.merge_logs(*[done[s] for s in behind]))] if behind else []
            done[name] = order.merge_logs(*parts)
        return done

    return order.merge_logs(*first), rest


def start_topology(spec: dict[str, dict], inputs: dict[str, DataFrame], path: str, order_cols: tuple[str, ...] | None = None, subscribers: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer of the whole topology as one streaming query, to be started; its state and its log table lie below ``path``.

    Each batch is parsed, passed to the pipelines that read others, merged and numbered (see ``seq_sink``): the rows are at ``<path>/rows``, and a batch that comes
    again is numbered as before. ``subscribers``, a ``FanOut`` for instance, get the numbered rows of each batch. Rows of one batch are in one order; over batches they go as they come.
    Pipelines of chunks keep state, so start them inside ``state_store``.
    """
    stream, rest = stream_topology(spec, inputs)

    def run(batch: DataFrame, batch_id: int) -> None:
        with passing():
            rows, default_order = _merged(rest(materialize(batch, "topology")))  # several pipelines read it
            order.seq_sink(path, order_cols or default_order)(rows, batch_id)
        if subscribers:
            subscribers(batch.sparkSession.read.parquet(f"{path}/rows/batch={batch_id}"), batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state")
