"""Order, sequence numbers and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.storage import materialize, passing

_LOCAL = (1 << 33) - 1


def reorder(logs: DataFrame, tie_columns: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Rows by timestamp, ties by ``tie_columns``. On streams see ``loomlog.streaming.reorder_stream``."""
    return logs.orderBy("timestamp_ns", *[c for c in tie_columns if c in logs.columns])


def merge_logs(*logs: DataFrame) -> DataFrame:
    """All rows of all inputs; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def assign_seq(logs: DataFrame, order_cols: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """``seq``, a dense number from 1 by ``order_cols``, which must be unique together.

    Rows are dealt by range, numbered within their partition, and shifted by the rows of the partitions before, a table of one row a partition. The
    dealt rows are written once, because the bounds of ranges are sampled and may differ from one evaluation to the next.
    """
    n = partitions or int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = logs.drop("seq") if "seq" not in order_cols else logs.withColumnRenamed("seq", "_old_seq")
    order = ["_old_seq" if c == "seq" else c for c in order_cols]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "seq").withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit(_LOCAL)))
    counts = dealt.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = dealt.join(F.broadcast(counts), "_part").withColumn("seq", F.col("_before") + F.col("_row") + 1)
    return out.drop("_part", "_at", "_row", "_before", "_old_seq")


def seq_sink(path: str, order_cols: tuple[str, ...], partitions: int | None = None):
    """``assign_seq`` for ``foreachBatch``: numbers go on from batch to batch, rows below ``path/rows/batch=<id>``.

    The last number of each batch is kept beside the rows, so a batch that comes again is numbered as before. A batch is written before its ranges are sampled, so that a stream's
    state is gone through once.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("last long, batch long").parquet(f"{path}/last") if batch_id else None
        before = (known.where(F.col("batch") < batch_id).agg(F.max("last")).first()[0] or 0) if known else 0
        with passing():
            rows = assign_seq(materialize(batch, "batch"), order_cols, partitions).withColumn("seq", F.col("seq") + before)
            rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        done = spark.read.schema(rows.schema).parquet(f"{path}/rows/batch={batch_id}")
        done.agg(F.coalesce(F.max("seq"), F.lit(before)).alias("last")).write.mode("overwrite").parquet(f"{path}/last/batch={batch_id}")

    return put


def retain_last(logs: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """The newest ``max_rows`` rows by ``seq``, exactly."""
    newest = logs.agg(F.max("seq").alias("_max"))
    return logs.where(F.col("seq") > newest.scalar() - max_rows)


def read_since(logs: DataFrame, after_seq: int) -> DataFrame:
    """Rows after a cursor; ``seq`` statistics prune what is read."""
    return logs.where(F.col("seq") > after_seq)
