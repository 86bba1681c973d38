"""The data model: log rows, levels, and the schemas of what comes in.

``timestamp_ns`` (Unix nanoseconds) orders rows; ``ts`` is derived from it for windows and formats. Devices and modules are
lower-case texts; a module is a dotted path, ``''`` the root of its device. ``seq`` is the dense number of a row in
merged order, given once by ``assign_seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Value, short name, long name, colour of each level.
LEVELS = [
    (0, "ALL", "ALL", "#888888"),
    (5, "T", "TRACE", "#888888"),
    (10, "D", "DEBUG", "#aaaaaa"),
    (20, "I", "INFO", "#eeeeee"),
    (30, "W", "WARNING", "#FFCC00"),
    (40, "E", "ERROR", "#FF3333"),
    (45, "F", "FATAL", "#ff33cc"),
    (50, "C", "CRITICAL", "#ff33cc"),
    (100, "OFF", "OFF", "#888888"),
]
ALL, TRACE, INFO, WARNING, ERROR, OFF = 0, 5, 20, 30, 40, 100

LOG_COLUMNS = ("timestamp_ns", "device", "module", "level", "message")
CHUNKS = "source string, chunk_seq long, timestamp_ns long, payload binary"
UNKNOWN = "_unknown"


def level_number(level: int | str) -> int:
    """A level's number from its number or long name."""
    if isinstance(level, str):
        found = [v for v, _, long, _ in LEVELS if long == level]
        if not found:
            raise ValueError(f"unknown level {level!r}; known: {', '.join(x[2] for x in LEVELS)}")
        return found[0]
    return int(level)


def level_name(level: Column) -> Column:
    """The short name of a level column; null if it is none."""
    pairs = [F.lit(x) for v, short, _, _ in LEVELS for x in (v, short)]
    return F.create_map(*pairs)[level]


def is_level(level: Column) -> Column:
    return level.isin([x[0] for x in LEVELS])


def with_ts(logs: DataFrame) -> DataFrame:
    return logs.withColumn("ts", F.expr("timestamp_micros(timestamp_ns div 1000)"))


def levels(spark: SparkSession) -> DataFrame:
    """The levels as a table, bold from WARNING up."""
    rows = [(v, short, long, color, v >= WARNING) for v, short, long, color in LEVELS]
    return spark.createDataFrame(rows, "value int, short string, long string, color string, bold boolean")
