"""What the operators of this subpackage share: tables, shared storage, row keys, words.

Rows are identified inside the operators by ``row_keys``: the id column together with a
hash of the text. Rows that agree in both are copies of one row and get the same result, so an
operator never needs a generated row number that a lost executor could deal anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.storage import drop, drop_scratch, materialize, passing, scratch, shared_dir

__all__ = ["SPACES", "by_bitmap", "drop", "drop_scratch", "every", "length_without", "let", "lines_of", "materialize", "named", "only_rows", "passing", "row_keys", "same_row", "scratch", "shared_dir", "table", "words_of"]

#: Fixed value: the bytes that separate words, as the contracts name them (space and 0x09-0x0D).
SPACES = " \t\n\x0b\x0c\r"
#: The bitmap by which ``by_bitmap`` tells rows apart has so many bits, as a power of two (8 MB).
BITMAP = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The top-level column of just that name, dots and all."""
    return F.col(f"`{column.replace('`', '``')}`")


def every(docs: DataFrame) -> Column:
    """All columns of a row as one struct."""
    return F.struct(*[named(c) for c in docs.columns])


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """``_id`` and ``_key``: null-safe identity of a row by its id and text."""
    text = F.coalesce(named(text_col), F.lit(""))
    return [named(id_col).alias("_id"), F.xxhash64(F.coalesce(named(id_col).cast("string"), F.lit("\x00")), text).alias("_key")]


def same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joins on ``_key`` and ``_id``, null ids too; keeps the left columns and the right's others."""
    right = right.withColumnRenamed("_id", "_rid").withColumnRenamed("_key", "_rkey")
    out = left.join(right, (left["_key"] == right["_rkey"]) & left["_id"].eqNullSafe(right["_rid"]), how)
    return out.drop("_rid", "_rkey")


def by_bitmap(rows: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose column ``on`` can be among ``keys``, and those where it is not: by a bitmap of fixed size, so no row is shuffled.

    Some of the first are not among the keys, either; a join tells.
    """
    width = 1 << 15  # bits of one of Spark's bitmaps
    slot = F.call_function("shiftrightunsigned", F.xxhash64(on), F.lit(64 - BITMAP))
    part, bit = F.floor(slot / width), slot % width
    bits = keys.select(part.alias("_part"), bit.alias("_bit")).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bits = materialize(bits, "bitmap")  # at most 2048 rows of 4 KB each
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    known = rows.join(F.broadcast(bits), part == bits["_part"], "left")
    return known.where(may).select(*rows.columns), known.where(~may).select(*rows.columns)


def only_rows(rows: DataFrame, kept: DataFrame, rest: DataFrame) -> DataFrame:
    """The rows whose ``_id`` and ``_key`` are in ``kept``; all others are in ``rest``.

    Whole rows are joined only where a bitmap of the smaller of the two does not tell, at most about half of them.
    """
    if kept.count() <= rest.count():
        return same_row(by_bitmap(rows, kept, "_key")[0], kept, "left_semi")
    doubtful, sure = by_bitmap(rows, rest, "_key")
    return sure.union(same_row(doubtful, rest, "left_anti"))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def lines_of(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")


def length_without(text: Column, kind: str) -> Column:
    """The length of a text without the characters of a class."""
    return F.length(F.regexp_replace(text, f"[{kind}]+", ""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
