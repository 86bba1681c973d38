"""Numeric series of modules, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.functions import text as T


def numeric_series(logs: DataFrame, module_ids: list[str] | None = None) -> DataFrame:
    """``device, module, seq, timestamp_ns, channel, value`` of the chosen modules (all by default).

    A module has as many channels as its first row with a number has numbers; further numbers are cut, and a row with fewer gives those it has.
    """
    rows = logs
    if module_ids is not None:
        wanted = F.lit(False)
        for device, module in map(T.split_id, module_ids):
            wanted = wanted | ((F.col("device") == device) & (F.col("module") == module))
        rows = rows.where(wanted)
    numbers = rows.select("device", "module", "seq", "timestamp_ns", T.extract_numbers(F.col("message")).alias("_n")).where("size(_n) > 0")
    first = numbers.groupBy("device", "module").agg(F.min_by(F.size("_n"), "seq").alias("_channels"))
    return numbers.join(first, ["device", "module"]).select("device", "module", "seq", "timestamp_ns", F.posexplode(F.slice("_n", F.lit(1), F.col("_channels"))).alias("channel", "value"))


def channel_names(series: DataFrame) -> DataFrame:
    """``device, module, channel, name``: the short name, numbered if the module has several channels."""
    most = series.groupBy("device", "module").agg((F.max("channel") + 1).alias("_n"))
    short = F.element_at(F.split("module", "[.]"), -1)
    every = most.select("device", "module", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("channel"))
    return every.select("device", "module", "channel", F.when(F.col("_n") > 1, F.concat(short, F.lit(" "), F.col("channel").cast("string"))).otherwise(short).alias("name"))


def rolling_points(series: DataFrame, max_points: int = 10_000) -> DataFrame:
    """The newest ``max_points`` rows of each module and channel."""
    order = Window.partitionBy("device", "module", "channel").orderBy(F.desc("seq"))
    return series.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max_points).drop("_rank")


def view_window(series: DataFrame, duration_s: int, end_ns: int | None = None) -> DataFrame:
    """Points within ``duration_s`` of the newest point of all modules, or of a fixed end. A duration not positive does not restrict."""
    if duration_s <= 0:
        return series
    span = duration_s * 1_000_000_000
    if end_ns is not None:
        return series.where(F.col("timestamp_ns").between(end_ns - span, end_ns))
    newest = series.agg(F.max("timestamp_ns").alias("_end"))
    return series.where(F.col("timestamp_ns") >= newest.scalar() - span)


def series_with_children(logs: DataFrame, identifier: str) -> DataFrame:
    """The series of all modules below one, itself left out."""
    device, module = T.split_id(identifier)
    below = (F.col("module") != "") if module == "" else F.col("module").startswith(f"{module}.")
    return numeric_series(logs.where((F.col("device") == device) & below))


def series_to_wide(series: DataFrame, channels: list[int]) -> DataFrame:
    """``device, module, seq, timestamp_ns`` and a column ``c<i>`` a channel."""
    columns = [F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"c{c}") for c in channels]
    return series.groupBy("device", "module", "seq", "timestamp_ns").agg(*columns)
