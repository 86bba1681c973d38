"""Devices and modules with ids that never change, kept over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.functions import text as T
from loomlog.operators import modules as M
from loomlog.storage import names_in

_DEVICES = "device string, device_id int, first_seq long, batch long"
_MODULES = "device string, module string, parent string, short_name string, depth int, first_seq long, ancestors array<string>, module_id int, batch long"


class Registry:
    """Append-only tables of devices and modules below ``path``: what a batch brings gets the next ids, and what has one keeps it.

    Device ids are dense from 0, module ids dense from 0 within their device; within a batch they go by the order first seen, ancestors first, and ancestors and the device's root
    are added with a module. A batch is one commit below its number: a batch that comes again sees only the commits before it, so it takes the place of its first
    try with the same ids. Batches must come in the order of their numbers, as those of a stream do.

    >>> registry = Registry(spark, path)
    >>> logs.writeStream.foreachBatch(registry.add)
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, kind: str, schema: str, before: int | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}") if names_in(self.spark, f"{self.path}/{kind}") else self.spark.createDataFrame([], schema)
        return rows if before is None else rows.where(F.col("batch") < before)

    def devices(self, before: int | None = None) -> DataFrame:
        """``device, device_id, first_seq``; of the commits under a batch number, or of all."""
        return self._read("devices", _DEVICES, before).drop("batch")

    def modules(self, before: int | None = None) -> DataFrame:
        """As ``modules`` gives them, with the ids of this registry."""
        return self._read("modules", _MODULES, before).drop("batch")

    def add(self, logs: DataFrame, batch_id: int) -> None:
        """Commits what is new in ``device, module, seq`` rows. Rows without a device or module bring nothing."""
        logs = logs.where("device is not null and module is not null").select(T.normalize_device(F.col("device")).alias("device"), "module", "seq")
        known = self.devices(batch_id)
        new = M.devices(logs).drop("device_id").join(known.select("device"), "device", "left_anti")
        order = Window.orderBy("first_seq", "device")  # a row a device
        base = known.agg(F.max("device_id")).first()[0]
        fresh = new.withColumn("device_id", F.row_number().over(order) + (-1 if base is None else base))
        fresh.select("device", F.col("device_id").cast("int"), "first_seq").write.mode("overwrite").parquet(f"{self.path}/devices/batch={batch_id}")

        known = self.modules(batch_id)
        new = M.modules(logs).drop("module_id").join(known.select("device", "module"), ["device", "module"], "left_anti")
        base = known.groupBy("device").agg((F.max("module_id") + 1).alias("_base"))
        inside = Window.partitionBy("device").orderBy("first_seq", "depth", "module")
        fresh = new.join(base, "device", "left").withColumn("module_id", (F.row_number().over(inside) - 1 + F.coalesce("_base", F.lit(0))).cast("int"))
        columns = [c.split()[0] for c in _MODULES.split(", ")][:-1]
        fresh.select(*columns).write.mode("overwrite").parquet(f"{self.path}/modules/batch={batch_id}")

    def with_ids(self, logs: DataFrame) -> DataFrame:
        """The rows with ``device_id`` and ``module_id``; null where they are not registered. The log may be a stream."""
        ids = self.modules().select(F.col("device").alias("_d"), F.col("module").alias("_m"), "module_id").join(self.devices().select(F.col("device").alias("_d"), "device_id"), "_d")
        out = logs.join(ids, (F.lower(logs["device"]) == F.col("_d")) & (logs["module"] == F.col("_m")), "left")
        return out.drop("_d", "_m")
