"""Latest values, changes, staleness, throughput and overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.model import with_ts

NOTHING = "---"


def latest_by_module(logs: DataFrame) -> DataFrame:
    """The last row by ``seq`` of each module; partial aggregation, also on streams in update mode."""
    newest = logs.groupBy("device", "module").agg(F.max(F.struct("seq", "timestamp_ns", "level", "message")).alias("_r"))
    return newest.select("device", "module", "_r.seq", "_r.timestamp_ns", "_r.level", "_r.message")


def telemetry_table(logs: DataFrame, known: DataFrame) -> DataFrame:
    """``device, module, value`` of all known modules; without a row ``---``."""
    newest = latest_by_module(logs).select("device", "module", "message")
    return known.select("device", "module").join(newest, ["device", "module"], "left").select("device", "module", F.coalesce("message", F.lit(NOTHING)).alias("value"))


def sort_table(rows: DataFrame, column: str = "module", descending: bool = False) -> DataFrame:
    """By device, module or value, ties by device and module."""
    if column not in ("device", "module", "value"):
        raise ValueError(f"unknown column {column!r}; known: device, module, value")
    return rows.orderBy(F.desc(column) if descending else F.asc(column), "device", "module")


def watch_latest(logs: DataFrame, watches: DataFrame) -> DataFrame:
    """``watch, position, kind, label, value``: a row's newest message over its modules; sections pass through."""
    newest = latest_by_module(logs).select("device", "module", "seq", "message")
    wanted = watches.where("kind = 'row'").select("watch", "position", F.explode("module_ids").alias("_id"))
    wanted = wanted.withColumn("_d", F.lower(F.substring_index("_id", ".", 1))).withColumn("_m", F.lower(F.regexp_replace("_id", r"^[^.]*\.?", "")))
    found = wanted.join(newest, (F.col("_d") == F.col("device")) & (F.col("_m") == F.col("module"))).groupBy("watch", "position").agg(F.max_by("message", "seq").alias("_value"))
    out = watches.join(found, ["watch", "position"], "left")
    return out.select("watch", "position", "kind", "label", F.when(F.col("kind") == "row", F.coalesce("_value", F.lit(NOTHING))).alias("value"))


def value_changes(logs: DataFrame, block: int = 1_000_000) -> DataFrame:
    """The rows whose message differs from the one before in their module; the first row counts. Null devices and modules are modules like others.

    Rows of one ``seq`` go by ``kv_pos`` where there is one. Modules are cut into blocks of ``seq``, and the last message of the block before is carried over, so that a
    busy module is not one task.
    """
    place = [c for c in ("seq", "kv_pos") if c in logs.columns]
    # a struct can be a key even where its fields are null
    rows = logs.withColumns({"_key": F.struct("device", "module"), "_block": F.floor(F.col("seq") / block)})
    last = rows.groupBy("_key", "_block").agg(F.max(F.struct(*place, F.struct("message").alias("m"))).alias("_l"))
    carried = last.select("_key", "_block", F.lag("_l.m").over(Window.partitionBy("_key").orderBy("_block")).alias("_carried"))
    inside = F.lag(F.struct("message")).over(Window.partitionBy("_key", "_block").orderBy(*place))
    before = rows.withColumn("_inside", inside).join(carried, ["_key", "_block"]).withColumn("_before", F.coalesce("_inside", "_carried")["message"])
    return before.where(~F.col("message").eqNullSafe(F.col("_before")) | F.col("_before").isNull()).select(*logs.columns)


def last_change(logs: DataFrame) -> DataFrame:
    """``device, module, seq, timestamp_ns`` of each module's last change."""
    return value_changes(logs).groupBy("device", "module").agg(F.max("seq").alias("seq"), F.max_by("timestamp_ns", "seq").alias("timestamp_ns"))


def staleness(logs: DataFrame, known: DataFrame, as_of_ns: int, threshold_s: float = 30) -> DataFrame:
    """``device, module, newest_ns, stale``; a module without a row is stale."""
    newest = logs.groupBy("device", "module").agg(F.max("timestamp_ns").alias("newest_ns"))
    out = known.select("device", "module").join(newest, ["device", "module"], "left")
    return out.withColumn("stale", F.coalesce(as_of_ns - F.col("newest_ns") > int(threshold_s * 1e9), F.lit(True)))


def throughput(rows: DataFrame, size_col: str = "message", seconds: int = 1) -> DataFrame:
    """``window_start, rows, bytes`` per tumbling window; also on streams."""
    windows = with_ts(rows).groupBy(F.window("ts", f"{seconds} seconds").alias("_w"))
    return windows.agg(F.count("*").alias("rows"), F.sum(F.octet_length(size_col)).cast("long").alias("bytes")).select(F.col("_w.start").alias("window_start"), "rows", "bytes")


def backlog(sent: DataFrame, received: DataFrame) -> DataFrame:
    """``window_start, backlog``: rows sent less rows received so far, from two outputs of ``throughput`` (a row a window)."""
    both = sent.select("window_start", F.col("rows").alias("n")).union(received.select("window_start", -F.col("rows")))
    per = both.groupBy("window_start").agg(F.sum("n").alias("n")).withColumn("_day", F.to_date("window_start"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = per.groupBy("_day").agg(F.sum("n").alias("_n")).select("_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = F.sum("n").over(Window.partitionBy("_day").orderBy("window_start"))
    return per.join(days, "_day").select("window_start", (F.col("_before") + here).alias("backlog"))


def overload_periods(logs: DataFrame, limit_per_sec: int = 1000, burst_seconds: int = 3, instant_cap: int = 5000) -> DataFrame:
    """``start_s, end_s, peak, rows`` of runs of seconds over the limit that trigger a pause.

    A run triggers if one second holds more than ``instant_cap`` rows, or if it lasts: the first second over the limit starts the clock, and
    ``burst_seconds`` later the rate is still over. A second at or below the limit ends the run; missing seconds hold nothing.
    """
    per = logs.groupBy(F.expr("timestamp_ns div 1000000000").alias("s")).agg(F.count("*").alias("n")).where(F.col("n") > min(limit_per_sec, instant_cap))
    # consecutive seconds, day by day; runs that touch midnight, two a day at most, are then joined over days
    day = F.floor(F.col("s") / 86_400)
    numbered = per.withColumn("_day", day).withColumn("_g", F.col("s") - F.row_number().over(Window.partitionBy("_day").orderBy("s")))
    parts = numbered.groupBy("_day", "_g").agg(F.min("s").alias("start_s"), F.max("s").alias("end_s"), F.max("n").alias("peak"), F.sum("n").alias("rows")).drop("_day", "_g")
    midnight = (F.col("start_s") % 86_400 == 0) | ((F.col("end_s") + 1) % 86_400 == 0)
    order = Window.orderBy("start_s")
    new = F.coalesce((F.col("start_s") - F.lag("end_s").over(order) > 1).cast("int"), F.lit(1))
    touching = parts.where(midnight).withColumn("_new", new).withColumn("_g", F.sum("_new").over(order))
    joined = touching.groupBy("_g").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("peak").alias("peak"), F.sum("rows").alias("rows")).drop("_g")
    runs = parts.where(~midnight).unionByName(joined)
    return runs.where((F.col("peak") > instant_cap) | (F.col("end_s") - F.col("start_s") >= burst_seconds))
