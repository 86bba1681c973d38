"""Raw captures and byte files."""

from __future__ import annotations

import struct
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The record heads of the two capture layouts (sync, type, version, reserved, length, ns; or ns, length).
HEADS = {"v1": struct.Struct("<BBBBIQ"), "v0": struct.Struct("<QH")}
SYNC = 0xA5
#: Records that a task holds as rows at once.
_BATCH = 4_096
_OUT = "source string, part int, chunk_seq long, timestamp_ns long, kind int, payload binary, bad_offset long"


def _records(content: bytes, layout: str):
    """(timestamp, kind, payload, None) per record; (None, None, None, offset) once where the part breaks off."""
    head, at = HEADS[layout], 0
    while at < len(content):
        if at + head.size > len(content):
            yield None, None, None, at
            return
        if layout == "v1":
            sync, kind, _, _, size, ns = head.unpack_from(content, at)
        else:
            (ns, size), sync, kind = head.unpack_from(content, at), SYNC, 1
        end = at + head.size + size
        if sync != SYNC or end > len(content):
            yield None, None, None, at
            return
        yield ns, kind, content[at + head.size : end], None
        at = end


def read_raw_capture(spark: SparkSession, path: str, layout: str = "v1") -> DataFrame:
    """Chunks of the capture parts ``<id>.<part>.bin`` under a path, a task a part (parts are rolled at 100 MiB).

    A bad sync byte or a cut record ends its part with one row that has only ``bad_offset``. Order is (source, part, chunk_seq).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select(F.regexp_extract(name, r"^(.*)\.(\d+)\.bin$", 1).alias("source"), F.regexp_extract(name, r"^(.*)\.(\d+)\.bin$", 2).try_cast("int").alias("part"), "content")
    return parse_captures(named, layout)


def parse_captures(parts: DataFrame, layout: str = "v1") -> DataFrame:
    """Chunks of capture parts given as rows ``source, part, content``; null contents hold none."""
    if layout not in HEADS:
        raise ValueError(f"unknown layout {layout!r}; known: {', '.join(HEADS)}")
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches):
        for batch in batches:
            for source, part, content in zip(*(batch.column(c) for c in ("source", "part", "content")), strict=True):
                rows = enumerate(_records(content.as_py() or b"", layout))
                while some := [(source.as_py(), part.as_py(), k, ns, kind, payload, bad) for k, (ns, kind, payload, bad) in islice(rows, _BATCH)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    return parts.select("source", "part", "content").mapInArrow(run, _OUT)


def read_byte_file(spark: SparkSession, path: str, chunk_size: int = 8, frequency: float = 100.0, start_ns: int = 0, loops: int = 1) -> DataFrame:
    """Files cut into pieces of ``chunk_size`` bytes, piece i stamped ``start_ns + i * 1e9 / frequency``, read ``loops`` times over."""
    files = spark.read.format("binaryFile").load(path)
    return cut_bytes(files.select(F.element_at(F.split("path", "/"), -1).alias("source"), "content"), chunk_size, frequency, start_ns, loops)


def cut_bytes(files: DataFrame, chunk_size: int = 8, frequency: float = 100.0, start_ns: int = 0, loops: int = 1) -> DataFrame:
    """The chunks of files given as rows ``source, content``; stamps are rounded down and do not drift. Empty and null contents have none."""
    rate = Fraction(frequency).limit_denominator(1_000_000)
    per_loop = F.ceil(F.octet_length("content") / chunk_size).cast("long")
    files = files.select("source", "content", per_loop.alias("_n")).where("_n > 0")
    rows = files.select("source", "content", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") * loops - 1)).alias("chunk_seq"))
    piece = F.substring("content", (F.col("chunk_seq") % F.col("_n") * chunk_size + 1).cast("int"), F.lit(chunk_size))
    span = 1_000_000_000 * rate.denominator  # nanoseconds of as many pieces as the rate's numerator
    ns = F.expr(f"{start_ns}L + chunk_seq div {rate.numerator}L * {span}L + chunk_seq % {rate.numerator}L * {span}L div {rate.numerator}L")
    return rows.select("source", "chunk_seq", ns.alias("timestamp_ns"), piece.alias("payload"))


def write_raw_capture(chunks: DataFrame, path: str, files: int | None = None) -> None:
    """A lossless store of chunks: Parquet sorted by source and place, so that statistics prune by source; sources share files, and a large one is split."""
    n = files or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks.repartitionByRange(n, "source", "chunk_seq").sortWithinPartitions("source", "chunk_seq").write.mode("append").parquet(path)


def raw_capture_sink(path: str, files: int = 1):
    """``write_raw_capture`` for ``foreachBatch``: a batch that comes again takes the place of its first try, below ``batch=<id>``."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.repartitionByRange(files, "source", "chunk_seq").sortWithinPartitions("source", "chunk_seq").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return put


def session_manifest(chunks: DataFrame, roll_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """Per source: chunks, parts, total_bytes, created_ns, finished_ns, duration_seconds (3 decimals).

    ``parts`` are the files that hold the source's payloads: a new one begins with the first chunk beyond each multiple of ``roll_bytes``.
    """
    size = F.octet_length("payload")
    out = chunks.groupBy("source").agg(
        F.count("*").alias("chunks"), F.sum(size).cast("long").alias("total_bytes"), F.max_by(size, "chunk_seq").alias("_last"),
        F.min("timestamp_ns").alias("created_ns"), F.max("timestamp_ns").alias("finished_ns"),
    )
    parts = F.floor((F.col("total_bytes") - F.col("_last")) / roll_bytes) + 1
    seconds = F.round((F.col("finished_ns") - F.col("created_ns")) / 1e9, 3)
    return out.select("source", "chunks", parts.alias("parts"), "total_bytes", "created_ns", "finished_ns", seconds.alias("duration_seconds"))


def rx_dump(rows: DataFrame, device: str) -> DataFrame:
    """TRACE rows of the module ``_reader.rx``: bytes as hex, frames with id and length."""
    if "payload" in rows.columns:
        text = F.lower(F.hex("payload"))
    else:
        text = F.concat(F.format_string("ID: %04X DLC: %d DATA: ", "arbitration_id", "dlc"), F.upper(F.hex("data")))
    keep = [c for c in ("source", "chunk_seq", "frame_seq") if c in rows.columns]
    return rows.select(*keep, "timestamp_ns", F.lit(device.lower()).alias("device"), F.lit("_reader.rx").alias("module"), F.lit(5).alias("level"), text.alias("message"))
