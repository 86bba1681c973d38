"""From byte chunks to log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.functions import text as T
from loomlog.model import ERROR, INFO, UNKNOWN, is_level


def split_lines(chunks: DataFrame, sep: int = 10, block: int = 10_000) -> DataFrame:
    """``source, line_no, timestamp_ns, raw``: payloads of each source joined in ``chunk_seq`` order and cut at the byte ``sep``.

    A line has the timestamp of the chunk that holds its separator; ``line_no`` counts separators from 0. Empty lines go, and so does the
    unterminated tail; a null source is a source like any other. Separators are counted by blocks of ``block`` chunks first, so that one large
    source is not one task. Lines inside one chunk go on as they are; only those that run over chunks are put together, and tails never are.
    """
    cut = {0: r"\x00"}.get(sep, f"\\x{sep:02X}")
    text = F.decode("payload", T.LATIN)
    # a struct of the source can be a key even where the source is null
    counted = chunks.select(F.struct("source").alias("_key"), "chunk_seq", "timestamp_ns", text.alias("_text"), F.floor(F.col("chunk_seq") / block).alias("_block"))
    counted = counted.withColumn("_cuts", (F.length("_text") - F.length(F.translate("_text", chr(sep), ""))).cast("long"))
    blocks = counted.groupBy("_key", "_block").agg(F.sum("_cuts").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_block")
    upto, total = F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("_n").over(Window.partitionBy("_key"))
    blocks = blocks.select("_key", "_block", (upto - F.col("_n")).alias("_before"), total.alias("_total"))
    inside = Window.partitionBy("_key", "_block").orderBy("chunk_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_here", F.sum("_cuts").over(inside) - F.col("_cuts")).join(blocks, ["_key", "_block"])
    pieces = placed.select("_key", "chunk_seq", "timestamp_ns", "_cuts", "_total", (F.col("_before") + F.col("_here")).alias("_first"), F.posexplode(F.split("_text", cut, -1)).alias("_i", "_piece"))
    pieces = pieces.withColumn("line_no", F.col("_first") + F.col("_i")).where("line_no < _total")
    own = pieces.where("_i > 0 and _i < _cuts").select("_key", "line_no", "timestamp_ns", F.col("_piece").alias("_line"))
    parts = pieces.where("_i = 0 or _i = _cuts").groupBy("_key", "line_no").agg(
        F.max(F.struct("chunk_seq", "timestamp_ns")).alias("_last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_seq", "_i", "_piece"))), lambda x: x["_piece"]), "").alias("_line"),
    )
    lines = own.union(parts.select("_key", "line_no", "_last.timestamp_ns", "_line"))
    return lines.where("_line <> ''").select("_key.source", "line_no", "timestamp_ns", F.encode("_line", T.LATIN).alias("raw"))


def parse_time(text: Column) -> Column:
    """Nanoseconds of ``[123.456]`` or ``123.456`` seconds; null if it is no such text."""
    pattern = r"^\[?(\d{1,10})(?:\.(\d{1,9}))?\]?$"
    whole, part = (F.regexp_extract(text, pattern, k) for k in (1, 2))
    return F.when(text.rlike(pattern), F.try_add(F.try_multiply(whole.try_cast("long"), F.lit(1_000_000_000)), F.rpad(part, 9, "0").try_cast("long")))


def parse_line(lines: DataFrame, device: str | Column, *, time_index: int | None = None, level_index: int | None = None, module_index: int | None = None, message_index: int = 0, level_map: str | dict[str, int] = "default", line_col: str = "line") -> DataFrame:
    """Log rows of text lines, with ``_error`` (the text at fault) where a line does not parse.

    The line is cut at white space into at most ``message_index`` + 1 words, the last being the message with its inner spacing. Without
    an index the level is INFO, the module ``_unknown``, the time the line's. A missing word, an unknown level, a bad
    module or a time that does not parse is an error, as is a null line; see ``route_errors``.
    """
    keep = [c for c in lines.columns if c not in ("timestamp_ns", "device", "module", "level", "message", "_error", line_col)]
    name = F.lit(device) if isinstance(device, str) else device
    text = F.coalesce(F.col(line_col), F.lit(""))
    rows = lines.select(*keep, F.col("timestamp_ns").alias("_chunk_ns"), T.normalize_device(name).alias("device"), text.alias("_text"))
    rows = rows.withColumn("_words", F.split(F.regexp_replace("_text", r"(?U)^\s+", ""), r"(?U)\s+", message_index + 1))
    word = lambda k: F.try_element_at("_words", F.lit(k + 1))
    rows = rows.select(
        *keep, "_chunk_ns", "device", "_text",
        (F.lit(UNKNOWN) if module_index is None else T.normalize_module(F.rtrim(word(module_index), F.lit(":")))).alias("module"),
        (F.lit(INFO) if level_index is None else T.map_level(word(level_index), level_map)).alias("level"),
        F.nullif(word(message_index), F.lit("")).alias("message"),
        (F.col("_chunk_ns") if time_index is None else parse_time(word(time_index))).alias("_time"),
    )
    bad = F.col("message").isNull() | F.col("level").isNull() | F.col("module").isNull() | F.col("_time").isNull()
    row = F.struct(F.when(bad, F.col("_chunk_ns")).otherwise(F.col("_time")).alias("timestamp_ns"), "device", "module", "level", "message", F.when(bad, F.col("_text")).alias("_error"))
    return rows.select(*keep, F.inline(F.array(row)))  # a filter on what is parsed stays behind this, so that lines are parsed once


def route_errors(rows: DataFrame, ignore_invalid: bool = False) -> DataFrame:
    """Rows with ``_error`` become ERROR rows of the module ``_unknown`` with that text, or go."""
    if ignore_invalid:
        return rows.where("_error is null").drop("_error")
    bad = F.col("_error").isNotNull()
    fixed = {"level": F.when(bad, ERROR).otherwise(F.col("level")), "module": F.when(bad, UNKNOWN).otherwise(F.col("module")), "message": F.coalesce("_error", "message")}
    return rows.withColumns(fixed).drop("_error")


def default_rows(lines: DataFrame, device: str | Column, line_col: str = "line") -> DataFrame:
    """INFO rows of the module ``log``, one a line."""
    name = F.lit(device) if isinstance(device, str) else device
    keep = [c for c in lines.columns if c not in ("timestamp_ns", "device", "module", "level", "message", line_col)]
    return lines.select(*keep, "timestamp_ns", T.normalize_device(name).alias("device"), F.lit("log").alias("module"), F.lit(INFO).alias("level"), F.col(line_col).alias("message"))


def extract_key_values(logs: DataFrame, out_device: str) -> DataFrame:
    """A row for each ``key=value`` of a message, in the module below the row's: ``kv_pos`` is the token's place.

    Tokens are parted by single spaces; the value loses trailing commas and semicolons; both sides must be non-empty. Paths that are no
    module are skipped, and so are the rows of ``out_device`` and ``system``.
    """
    out_device = out_device.lower()
    rows = logs.where(F.col("message").contains("=") & ~F.col("device").isin(out_device, "system"))
    keep = [c for c in logs.columns if c not in ("device", "module", "message", "ts", "kv_pos")]
    tokens = rows.select(*keep, F.col("module").alias("_module"), F.posexplode(F.split("message", " ", -1)).alias("kv_pos", "_token"))
    key, value = F.substring_index("_token", "=", 1), F.rtrim(F.regexp_replace("_token", "^[^=]*=", ""), F.lit(",;"))
    cut = tokens.where(F.col("_token").contains("=")).select(*keep, "kv_pos", F.lit(out_device).alias("device"), T.normalize_module(F.concat("_module", F.lit("."), key)).alias("module"), value.alias("message"), key.alias("_key"))
    return cut.where("_key <> '' and message <> '' and module is not null").drop("_key")


def records_to_logs(records: DataFrame, device: str) -> DataFrame:
    """Log rows of ``created_ns, levelno, name, msg``; a level or name that is none is an error (see ``route_errors``)."""
    module = T.normalize_module(F.col("name"))
    level = F.when(is_level(F.col("levelno")), F.col("levelno"))
    bad = module.isNull() | level.isNull()
    keep = [c for c in records.columns if c not in ("created_ns", "levelno", "name", "msg")]
    return records.select(*keep, F.col("created_ns").alias("timestamp_ns"), F.lit(device.lower()).alias("device"), module.alias("module"), level.alias("level"), F.col("msg").alias("message"), F.when(bad, F.col("msg")).alias("_error"))
