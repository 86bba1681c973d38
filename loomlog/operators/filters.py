"""Filters. Each is one predicate where it can be, so that a chain of them is one pushed-down filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions import text as T
from loomlog.model import ALL, OFF, level_number
from loomlog.operators.order import read_since
from loomlog.storage import materialize

#: Effective levels of more bytes than this are joined by shuffle instead of broadcast.
MOST_BROADCAST_BYTES = 32_000_000


def filter_level(logs: DataFrame, min_level: int | str) -> DataFrame:
    level = level_number(min_level)
    if level == ALL:
        return logs
    return logs.where(F.lit(False)) if level == OFF else logs.where(F.col("level") >= level)


def filter_device(logs: DataFrame, device: str) -> DataFrame:
    return logs.where(F.col("device") == device.lower())


def filter_module(logs: DataFrame, identifier: str) -> DataFrame:
    device, module = T.split_id(identifier)
    return logs.where((F.col("device") == device) & (F.col("module") == module))


def filter_subtree(logs: DataFrame, identifier: str) -> DataFrame:
    """The module and all below it."""
    device, module = T.split_id(identifier)
    return logs.where((F.col("device") == device) & T.within(F.col("module"), module))


def filter_siblings(logs: DataFrame, identifier: str) -> DataFrame:
    """The subtree of the module's parent; a root has none, so its whole device."""
    device, module = T.split_id(identifier)
    return filter_subtree(logs, f"{device}.{module.rpartition('.')[0]}")


def effective_levels(modules: DataFrame, overrides: DataFrame, default_level: int | str) -> DataFrame:
    """``device, module, min_level``: the nearest listed ancestor's level (OFF if disabled), else the default."""
    default = level_number(default_level)
    parts = F.split("module", "[.]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    lineage = F.when(F.col("module") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), prefixes))
    steps = modules.select("device", "module", F.posexplode(lineage).alias("_depth", "_path"))
    own = overrides.select(F.col("device").alias("_d"), F.col("module").alias("_path"), F.when(F.col("enabled"), F.col("level")).otherwise(OFF).alias("_level"))
    found = steps.join(own, (steps["device"] == own["_d"]) & (steps["_path"] == own["_path"]), "left")
    nearest = found.groupBy("device", "module").agg(F.max_by("_level", F.when(F.col("_level").isNotNull(), F.col("_depth"))).alias("_level"))
    return nearest.select("device", "module", F.coalesce("_level", F.lit(default)).alias("min_level"))


def filter_module_levels(logs: DataFrame, overrides: DataFrame, default_level: int | str = ALL, known: DataFrame | None = None) -> DataFrame:
    """Rows at or above their module's effective level; OFF lets nothing through.

    ``overrides`` has device, module, enabled, level. Levels are resolved on the distinct modules, not on the rows, and written once. ``known`` is
    a table of modules (device, module); where it is given, the rows are not read for them, so ``logs`` may be a stream. For the rows of modules
    that it lacks, and of null devices or modules, the default level decides.
    """
    found = logs.select("device", "module") if known is None else known.select("device", "module")
    limits = materialize(effective_levels(found.distinct(), overrides, default_level).withColumnsRenamed({"device": "_d", "module": "_m"}), "levels")
    size = limits.agg(F.sum(F.octet_length("_d") + F.octet_length("_m") + 48)).first()[0] or 0
    if size <= MOST_BROADCAST_BYTES:
        limits = F.broadcast(limits)
    out = logs.join(limits, (F.col("device") == F.col("_d")) & (F.col("module") == F.col("_m")), "left")
    least = F.coalesce("min_level", F.lit(level_number(default_level)))
    return out.where((F.col("level") >= least) & (least < OFF)).select(*logs.columns)


@dataclass(frozen=True)
class LogFilter:
    """What a view shows: parts that are None do not restrict."""

    device: str | None = None
    module: str | None = None
    children: bool = False
    level: int | str = ALL
    overrides: DataFrame | None = None
    known_modules: DataFrame | None = None
    after_seq: int | None = None


def apply_filter(logs: DataFrame, log_filter: LogFilter) -> DataFrame:
    """The conjunction of the filter's parts."""
    out = filter_level(logs, log_filter.level)
    if log_filter.after_seq is not None:
        out = read_since(out, log_filter.after_seq)
    if log_filter.module is not None:
        out = (filter_subtree if log_filter.children else filter_module)(out, log_filter.module)
    elif log_filter.device is not None:
        out = filter_device(out, log_filter.device)
    if log_filter.overrides is not None:
        out = filter_module_levels(out, log_filter.overrides, known=log_filter.known_modules)
    return out


def search_modules(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose ``module device`` text matches a search (see ``search_condition``)."""
    return rows.where(T.search_condition(F.concat_ws(" ", "module", "device"), query))


def find_text(lines: DataFrame, needle: str, text_col: str = "line") -> DataFrame:
    """Lines that hold the needle, any case, with the first place from 1; none for a blank needle."""
    if not needle.strip():
        return lines.where(F.lit(False)).withColumn("position", F.lit(0))
    place = F.instr(F.lower(F.col(text_col)), needle.lower())
    return lines.withColumn("position", place).where("position > 0")


def find_from(lines: DataFrame, needle: str, from_seq: int, forward: bool = True, text_col: str = "line") -> DataFrame:
    """One row, ``seq``: the next (or previous) match after ``from_seq``, from the other end if there is none."""
    pick, beyond = (F.min, F.col("seq") > from_seq) if forward else (F.max, F.col("seq") < from_seq)
    return find_text(lines, needle, text_col).agg(F.coalesce(pick(F.when(beyond, F.col("seq"))), pick("seq")).alias("seq"))
