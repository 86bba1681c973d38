"""Live chunks: a folder that files drop into, a Kafka topic, or (for tests) a socket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.model import CHUNKS


def stream_chunks(spark: SparkSession, options: dict) -> DataFrame:
    """A stream of chunks. ``options``: ``format`` (parquet, kafka, socket) and the source's own, such as ``path`` and ``maxFilesPerTrigger``.

    Kafka records need a source as key and the bytes as value; their timestamp counts.
    """
    own = dict(options)
    kind = own.pop("format", "parquet")
    if kind == "parquet":
        path = own.pop("path")
        return spark.readStream.schema(CHUNKS).options(**own).parquet(path)
    if kind == "kafka":
        raw = spark.readStream.format("kafka").options(**own).load()
        return raw.select(F.col("key").cast("string").alias("source"), F.col("offset").alias("chunk_seq"), (F.unix_micros("timestamp") * 1000).alias("timestamp_ns"), F.col("value").alias("payload"))
    if kind == "socket":
        raw = spark.readStream.format("socket").option("includeTimestamp", True).options(**own).load()
        ns = F.unix_micros("timestamp") * 1000
        return raw.select(F.lit("socket").alias("source"), ns.alias("chunk_seq"), ns.alias("timestamp_ns"), F.encode(F.concat("value", F.lit("\n")), "UTF-8").alias("payload"))
    raise ValueError(f"unknown format {kind!r}; known: parquet, kafka, socket")
