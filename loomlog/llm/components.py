"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.base import drop, materialize


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    least = materialize(least, f"{name}-least")  # a bare exchange on either side lets a node of many links be split
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, name: str) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("_m")), f"{name}-least")
    moved = down.join(least, "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.union(least.select("a", F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` but the roots; root is the smallest node reachable.

    Each round is two joins and partial aggregates over the edges left and is written to the shared folder. It
    ends when the edges are stars: no node has two parents, no parent is a child. Tables of earlier rounds go.
    """
    edges = materialize(edges.select("a", "b").where("a <> b"), name)
    while not edges.isEmpty():
        larger = materialize(_large_star(edges, name), name)
        before, edges = edges, materialize(_small_star(larger, name), name)
        drop(before, larger)
        parents = edges.select(F.col("b").alias("a")).distinct()
        n = edges.agg(F.count("*").alias("n"), F.countDistinct("a").alias("d")).first()
        if n["n"] == n["d"] and edges.join(parents, "a", "left_semi").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
