"""Query entry points and text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.model import ALL, level_name, with_ts
from loomlog.operators.filters import LogFilter, apply_filter, filter_level


def tail(logs: DataFrame, log_filter: LogFilter, total: int, after_seq: int = -1) -> DataFrame:
    """The newest ``total`` rows that pass, oldest first."""
    rows = apply_filter(logs.where(F.col("seq") > after_seq) if after_seq >= 0 else logs, log_filter)
    return rows.orderBy(F.desc("seq")).limit(total).orderBy("seq")


def clock() -> Column:
    """``HH:MM:SS.mmm`` of ``ts``, cut, not rounded, in the session's time zone."""
    return F.date_format("ts", "HH:mm:ss.SSS")


def render(logs: DataFrame, show_ts: bool = True, show_dev: bool = True, show_lvl: bool = True, show_mod: bool = True) -> DataFrame:
    """``seq, line``: the parts shown, parted by single spaces, then the message."""
    parts = [clock()] * show_ts + [F.col("device")] * show_dev + [level_name(F.col("level"))] * show_lvl + [F.concat("module", F.lit(":"))] * show_mod
    return with_ts(logs).select("seq", F.concat_ws(" ", *parts, "message").alias("line"))


def render_console(logs: DataFrame, min_level: int | str = ALL) -> DataFrame:
    """``seq, line`` for a console, a tab before the message."""
    rows = with_ts(filter_level(logs, min_level))
    return rows.select("seq", F.concat(F.concat_ws(" ", clock(), level_name(F.col("level")), F.col("device"), F.col("module"), F.lit("\t")), "message").alias("line"))


def session_line() -> Column:
    """``<ISO time in microseconds>Z <level> <device> <module>: <message>``, in UTC."""
    stamp = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(stamp, F.lit("Z "), F.concat_ws(" ", level_name(F.col("level")), "device", F.concat("module", F.lit(":")), "message"))
