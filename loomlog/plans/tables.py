"""Log tables derived from the analytics tables (events, documents), on which the registered queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.signals import SIGNALS


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("timestamp_ns", F.expr("unix_micros(cast(ts as timestamp)) * 1000"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row an event: devices by user, modules and levels by event type, numbers in the message."""
    return _events(spark, sf_dir).selectExpr(
        "event_id + 1 as seq", "timestamp_ns", "concat('dev', cast(user_id % 7 as string)) as device", "concat('app.', event_type) as module",
        "case event_type when 'error' then 40 when 'purchase' then 30 when 'signup' then 20 when 'click' then 10 else 5 end as level",
        "concat('cents=', cast(cast(round(value * 100) as bigint) as string), ', k=', regexp_extract(props, '[0-9]+', 0), ';') as message",
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rows as device lines ``[seconds.millis] L module: message``."""
    return logs(spark, sf_dir).selectExpr(
        "seq", "device", "timestamp_ns",
        "concat('[', cast(timestamp_ns div 1000000000 as string), '.', lpad(cast((timestamp_ns div 1000000) % 1000 as string), 3, '0'), '] ',"
        " case level when 40 then 'E' when 30 then 'W' when 20 then 'I' when 10 then 'D' else 'T' end, ' ', module, ': ', message) as line",
    )


def chunks(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """Documents as byte chunks of ``size`` characters, a final newline added."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("_t"))
    pieces = F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one pass over the text
    cut = docs.select("doc_id", F.posexplode(pieces).alias("_k", "_piece")).withColumn("chunk_seq", F.col("_k").cast("long"))
    return cut.select(F.col("doc_id").cast("string").alias("source"), "chunk_seq", (F.col("doc_id") * 1_000_000 + F.col("chunk_seq")).alias("timestamp_ns"), F.encode("_piece", "UTF-8").alias("payload"))


def _little_endian(number, size: int):
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.concat(*[F.substring(digits, k, 2) for k in range(2 * size - 1, 0, -2)])


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each document as one capture part, ``source, part, content``, with a record cut short at the end."""
    record = F.concat(F.lit("A5010100"), _little_endian(F.octet_length("payload"), 4), _little_endian(F.col("timestamp_ns"), 8), F.hex("payload"))
    parts = chunks(spark, sf_dir).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("chunk_seq", record.alias("r")))).alias("_r"))
    return parts.select("source", F.lit(0).alias("part"), F.unhex(F.concat(F.array_join("_r.r", ""), F.lit("A501"))).alias("content"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device lines, without their times and with an unknown level for errors, from twenty sources, each line in two chunks."""
    rows = raw_lines(spark, sf_dir).withColumn("line", F.regexp_replace(F.regexp_replace("line", r"^\S+ ", ""), "^E ", "? "))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.substring("line", 1, 10).alias("p")), F.struct(F.lit(1).alias("k"), F.concat(F.substring("line", 11, 1000), F.lit("\r\n")).alias("p"))))
    cut = rows.select((F.col("seq") % 20).cast("string").alias("source"), "seq", "timestamp_ns", halves.alias("_h"))
    return cut.select("source", (2 * F.col("seq") + F.col("_h.k")).alias("chunk_seq"), "timestamp_ns", F.encode("_h.p", "UTF-8").alias("payload"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bus frames of eight bytes: the low 16 bits of the user, 32 of the cents, 8 of k, and a negative number."""
    return _events(spark, sf_dir).selectExpr(
        "event_id as frame_seq", "timestamp_ns", "cast(256 + event_id % 3 as int) as arbitration_id", "8 as dlc",
        "unhex(format_string('%02X%02X%08X%02X%02X', user_id & 255, (user_id & 65535) div 256, cast(round(value * 100) as bigint) & 4294967295, cast(regexp_extract(props, '[0-9]+', 0) as int) & 255, (256 - user_id % 100) % 256)) as data",
    )


def signal_dict(spark: SparkSession) -> DataFrame:
    """What the frames' bytes mean, for two of the three frame ids."""
    rows = []
    for frame_id in (256, 257):
        rows += [
            (frame_id, "event", "user", 0, 16, True, False, 1.0, 0.0, None, None),
            (frame_id, "event", "cents", 23, 32, False, False, 0.01, 0.0, None, None),
            (frame_id, "event", "k", 48, 8, True, False, 1.0, 0.0, {7: "seven", 8: "eight"}, None),
            (frame_id, "event", "neg", 56, 8, True, True, 1.0, 0.0, None, None),
        ]
    return spark.createDataFrame(rows, SIGNALS)


def switched_signals(spark: SparkSession) -> DataFrame:
    """Signals of the frames' first two bytes that count only for certain values of ``k``."""
    rows = [
        (256, "event", "k", 48, 8, True, False, 1.0, 0.0, None, None, None), (256, "event", "low", 0, 8, True, False, 1.0, 0.0, None, 7, "k"),
        (256, "event", "high", 8, 8, True, False, 1.0, 0.0, None, 8, "k"), (256, "event", "never", 0, 8, True, False, 1.0, 0.0, None, 7, "none"),
    ]
    return spark.createDataFrame(rows, f"{SIGNALS}, mux_signal string")


def overrides(spark: SparkSession) -> DataFrame:
    rows = [("dev0", "", True, 20), ("dev0", "app", False, 0), ("dev0", "app.click", True, 5), ("dev1", "app.error", True, 50), ("dev2", "app", True, 30), ("dev3", "", False, 0)]
    return spark.createDataFrame(rows, "device string, module string, enabled boolean, level int")


def watches(spark: SparkSession) -> DataFrame:
    rows = [("w", 0, "section", "Main", None), ("w", 1, "row", "Clicks", ["dev0.app.click", "dev1.app.click"]), ("w", 2, "row", "Mixed", ["dev2.app.error", "dev9.none"]), ("w", 3, "row", "Empty", [])]
    return spark.createDataFrame(rows, "watch string, position int, kind string, label string, module_ids array<string>")
