"""Search in a large log by a table of trigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators.filters import find_text

#: Candidate blocks up to this many become ranges of ``seq`` that reach the scan; more are joined.
MOST_RANGES = 500


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-case text."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda k: F.substring(low, k, F.lit(3))))


def write_trigrams(lines: DataFrame, path: str, block: int = 4_096, text_col: str = "line", files: int | None = None) -> None:
    """``trigram, block`` for each trigram that stands in a line of a block of ``seq``, in order of trigrams, so that a search reads few of them."""
    each = lines.where(F.length(text_col) >= 3).select(F.explode(trigrams(F.col(text_col))).alias("trigram"), F.floor(F.col("seq") / block).alias("block"))
    n = files or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each.distinct().repartitionByRange(n, "trigram", "block").sortWithinPartitions("trigram", "block").write.parquet(path)


def candidate_blocks(index: DataFrame, needle: str) -> DataFrame:
    """The blocks that hold all trigrams of a needle of three characters or more."""
    low = needle.lower()
    wanted = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    return index.where(F.col("trigram").isin(wanted)).groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("block")


def find_indexed(lines: DataFrame, index: DataFrame, needle: str, block: int = 4_096, text_col: str = "line") -> DataFrame:
    """``find_text`` on ``lines``, a table in order of ``seq``, of which only blocks are read that may hold the needle.

    Few candidate blocks become ranges of ``seq`` that the scan prunes by; more are met in a join. A needle of one or two characters is searched in all lines, and so
    is one with characters outside ASCII, whose lower case may differ from the lines'.
    """
    if len(needle) < 3 or not needle.isascii() or not needle.strip():
        return find_text(lines, needle, text_col)
    blocks = candidate_blocks(index, needle)
    few = sorted(r["block"] for r in blocks.limit(MOST_RANGES + 1).collect())
    if len(few) > MOST_RANGES:
        near = lines.withColumn("_block", F.floor(F.col("seq") / block)).join(blocks.withColumnRenamed("block", "_block"), "_block", "left_semi").select(*lines.columns)
        return find_text(near, needle, text_col)
    runs: list[list[int]] = []
    for b in few:
        if runs and runs[-1][1] == b:
            runs[-1][1] = b + 1
        else:
            runs.append([b, b + 1])
    inside = [(F.col("seq") >= a * block) & (F.col("seq") < z * block) for a, z in runs]
    return find_text(lines.where(reduce(lambda x, y: x | y, inside, F.lit(False))), needle, text_col)
