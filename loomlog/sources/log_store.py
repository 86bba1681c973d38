"""The stored log table: rows in order of ``seq`` below batches, and its newest rows by range probing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.filters import LogFilter, apply_filter
from loomlog.operators.order import seq_sink
from loomlog.storage import names_in

#: Probes of ``newest`` begin with so many times the rows asked for.
FIRST_PROBE = 8


class LogStore:
    """What ``seq_sink`` writes: ``<path>/rows/batch=<id>``, ranges of ``seq`` a file, and ``<path>/last``, the last number of each batch.

    Statistics of ``seq`` tell which files a range of it needs, so a cursor or a probe reads few of them.
    """

    def __init__(self, spark: SparkSession, path: str, order_cols: tuple[str, ...] = ("timestamp_ns", "device", "module", "level", "message")):
        self.spark, self.path, self.order_cols = spark, path.rstrip("/"), order_cols

    def append(self, logs: DataFrame, batch_id: int) -> None:
        """Numbers and adds a batch; usable in ``foreachBatch``."""
        seq_sink(self.path, self.order_cols)(logs, batch_id)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("batch")

    def last_seq(self) -> int:
        """The newest number, from the small table beside the rows; 0 for an empty store."""
        if not names_in(self.spark, f"{self.path}/last"):
            return 0
        return self.spark.read.schema("last long").parquet(f"{self.path}/last").agg(F.max("last")).first()[0] or 0

    def newest(self, log_filter: LogFilter, total: int, after_seq: int = 0) -> DataFrame:
        """The newest ``total`` rows that pass, oldest first, as ``render.tail`` gives them.

        The last ``FIRST_PROBE * total`` numbers are read first, then twice as many, and so on, until enough rows pass or the beginning is reached: a filter that
        lets much through reads the end of the table only, and any other reads it all in the last probe, at most twice as much in all.
        """
        last, span = self.last_seq(), max(1, FIRST_PROBE * total)
        if total <= 0 or last == 0:
            return self.rows().limit(0) if last else self.spark.createDataFrame([], "seq long, timestamp_ns long, device string, module string, level int, message string")
        while True:
            low = max(after_seq, last - span)
            found = apply_filter(self.rows().where(F.col("seq") > low), log_filter).orderBy(F.desc("seq")).limit(total)
            if low <= after_seq or found.count() >= total:
                return found.orderBy("seq")
            span *= 2
