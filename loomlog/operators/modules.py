"""Devices and modules as tables; paths carry the hierarchy, so no step recurses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.functions import text as T


def devices(logs: DataFrame) -> DataFrame:
    """``device, device_id, first_seq``: dense ids from 0 in the order first seen."""
    first = logs.groupBy(T.normalize_device(F.col("device")).alias("device")).agg(F.min("seq").alias("first_seq"))
    return first.withColumn("device_id", F.row_number().over(Window.orderBy("first_seq", "device")) - 1)  # a row a device


def modules(logs: DataFrame) -> DataFrame:
    """Every module seen, its ancestors and each device's root, with parent, short name, depth, first_seq, ancestors.

    ``module_id`` is dense from 0 within its device, in the order first seen, ancestors first.
    """
    seen = logs.groupBy("device", "module").agg(F.min("seq").alias("_first"))
    parts = F.when(F.col("module") == "", F.array().cast("array<string>")).otherwise(F.split("module", "[.]"))
    paths = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n + 1), ".")))
    lineage = F.when(F.col("module") == "", F.array(F.lit(""))).otherwise(paths)
    every = seen.select("device", "_first", F.explode(lineage).alias("module")).groupBy("device", "module").agg(F.min("_first").alias("first_seq"))
    own = F.split("module", "[.]")
    depth = F.when(F.col("module") == "", 0).otherwise(F.size(own))
    above = F.when(F.col("module") == "", F.array().cast("array<string>")).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.slice(own, F.lit(1), F.size(own) - 1), lambda _, n: F.array_join(F.slice(own, F.lit(1), n + 1), ".")))
    )
    out = every.select("device", "module", T.parent_path(F.col("module")).alias("parent"), F.element_at(own, -1).alias("short_name"), depth.alias("depth"), "first_seq", above.alias("ancestors"))
    order = Window.partitionBy("device").orderBy("first_seq", "depth", "module")
    return out.withColumn("module_id", F.row_number().over(order) - 1)


def module_closure(known: DataFrame) -> DataFrame:
    """``device, ancestor, descendant`` for every pair, from the output of ``modules``."""
    return known.select("device", F.explode("ancestors").alias("ancestor"), F.col("module").alias("descendant"))


def resolve_modules(spark: SparkSession, identifiers: DataFrame, known: DataFrame, create: bool = False) -> DataFrame:
    """``identifier, device, module`` of ``device.path`` texts; those not known are left out, or added with ``create``; bad texts go."""
    device = F.lower(F.substring_index("identifier", ".", 1))
    module = F.lower(F.regexp_replace("identifier", r"^[^.]*\.?", ""))
    cut = identifiers.select("identifier", device.alias("device"), module.alias("module")).where("device <> ''").where((F.col("module") == "") | T.normalize_module(F.col("module")).isNotNull())
    return cut if create else cut.join(known.select("device", "module"), ["device", "module"], "left_semi").select("identifier", "device", "module")


def module_tree(known: DataFrame) -> DataFrame:
    """``device, module, label`` in reading order, indented by depth."""
    label = F.when(F.col("depth") == 0, F.col("device")).otherwise(F.concat(F.repeat(F.lit("    "), F.col("depth") - 1), F.lit("├── "), "short_name"))
    return known.select("device", "module", label.alias("label")).orderBy("device", "module")
