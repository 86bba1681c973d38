"""Session text logs, written and read back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.model import LEVELS, with_ts
from loomlog.operators.render import session_line
from loomlog.storage import drop, materialize, names_in, remove

_LINE = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6})Z (\S+) (\S+) ([a-z0-9_.]*): ([\s\S]*)$"


def one_line(message: Column) -> Column:
    """A message without line ends: backslashes are doubled, newlines and carriage returns written ``\\n`` and ``\\r``."""
    doubled = F.replace(message, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def many_lines(text: Column) -> Column:
    """The message of ``one_line``. A backslash before another letter stays."""
    ends = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), ends), "\\")


def parse_session_lines(lines: DataFrame, line_col: str = "line", escaped: bool = True) -> DataFrame:
    """timestamp_ns, device, module, level, message and ``_error`` (the line, where it does not match; see ``route_errors``).

    ``escaped`` undoes what ``one_line`` did; files written elsewhere may hold plain backslashes and need it off.
    """
    part = lambda k: F.regexp_extract(F.col(line_col), _LINE, k)
    pairs = [F.lit(x) for v, short, _, _ in LEVELS for x in (short, v)]
    level = F.create_map(*pairs)[part(2)]
    good = F.col(line_col).rlike(_LINE) & level.isNotNull()
    stamp = F.unix_micros(F.try_to_timestamp(F.concat(part(1), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"))) * 1000
    return lines.select(
        *[c for c in lines.columns if c != line_col], F.when(good, stamp).alias("timestamp_ns"), F.when(good, part(3)).alias("device"),
        F.when(good, part(4)).alias("module"), F.when(good, level).alias("level"), F.when(good, many_lines(part(5)) if escaped else part(5)).alias("message"), F.when(~good, F.col(line_col)).alias("_error"),
    )


def read_log_text(spark: SparkSession, path: str, escaped: bool = True) -> DataFrame:
    """The rows of session files below a path, in folders too (see ``parse_session_lines``)."""
    return parse_session_lines(spark.read.option("recursiveFileLookup", "true").text(path).withColumnRenamed("value", "line"), "line", escaped)


def _lines(logs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The session lines in ``value``, messages on one line each, and the columns that order them."""
    order = ["timestamp_ns", *[c for c in ("seq",) if c in logs.columns]]
    return with_ts(logs).withColumn("message", one_line(F.col("message"))).select(*order, session_line().alias("value")), order


def _measured(lines: DataFrame) -> tuple[int, int]:
    """Rows and bytes, line ends included."""
    return lines.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()


def _rolled(logs: DataFrame, roll_bytes: int, mode: str, path: str) -> None:
    """As many files as the bytes ask for, by ranges of time, so that files come near ``roll_bytes`` each; none holds more than twice the average row count."""
    lines, order = _lines(logs)
    n, size = _measured(lines)
    files = max(1, -(-size // roll_bytes))
    dealt = lines.repartitionByRange(files, *order).sortWithinPartitions(*order).select("value")
    dealt.write.option("maxRecordsPerFile", max(1, 2 * n // files)).mode(mode).text(path)


def write_session_log(logs: DataFrame, path: str, roll_bytes: int = 100 * 1024 * 1024) -> None:
    """One line a row, in order of time over the files; a new file about every ``roll_bytes`` bytes."""
    _rolled(logs, roll_bytes, "append", path)


def session_log_sink(path: str, roll_bytes: int = 100 * 1024 * 1024):
    """``write_session_log`` for ``foreachBatch``: a batch that comes again takes the place of its first try, below ``batch=<id>``."""
    return lambda batch, batch_id: _rolled(batch, roll_bytes, "overwrite", f"{path}/batch={batch_id}")


#: A task of ``SessionParts`` writes about so many bytes at most, many parts one after another where they are small.
TASK_BYTES = 64 * 1024 * 1024


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with ``_task`` and ``_start``, the bytes of the lines before in the same task."""

    def run(batches):
        before = 0
        for batch in batches:
            ends = before + np.cumsum(pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            starts = np.concatenate(([before], ends[:-1])) if len(ends) else ends
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], names=[*batch.schema.names, "_start"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(run, f"{fields}, _start long").withColumn("_task", F.spark_partition_id())


_PARTS = "part string, bytes long, rows long, first_ns long, last_ns long, open_bytes long, open_from int, batch int"


class SessionParts:
    """Session files that roll by bytes while rows come in small batches: ``add`` is for ``foreachBatch``.

    Lines wait in the open part, ``<path>/open/batch=<id>``, until they come to ``roll_bytes``; then they are written in order of time as ``<path>/parts/part=0000`` and
    so on, about ``roll_bytes`` each, so small batches make no small parts. Each batch leaves what it closed and how much is open in ``<path>/manifest/batch=<id>``, its
    commit: a batch that comes again after it changes nothing, one that failed before it is written anew under the same numbers, and a new writer on the
    same path goes on after the last part. ``finish`` closes what is open. The open part holds less than ``roll_bytes`` after every batch.
    """

    def __init__(self, spark: SparkSession, path: str, roll_bytes: int = 100 * 1024 * 1024):
        self.spark, self.path, self.roll_bytes = spark, path.rstrip("/"), roll_bytes

    def manifest(self) -> DataFrame:
        """A row a closed part: part (four digits), bytes, rows, first_ns, last_ns."""
        return self._entries().where("part is not null").select("part", "bytes", "rows", "first_ns", "last_ns")

    def _entries(self) -> DataFrame:
        if not names_in(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], _PARTS)
        return self.spark.read.schema(_PARTS).parquet(f"{self.path}/manifest")

    def _state(self) -> tuple[int, int, int, int]:
        """The last batch, the number of the next part, and the bytes and the first batch of the open one."""
        last = self._entries().agg(F.max("batch"), F.count("part"), F.max_by("open_bytes", "batch"), F.max_by("open_from", "batch")).first()
        return (-1, 0, 0, 0) if last[0] is None else tuple(last)

    def add(self, logs: DataFrame, batch_id: int) -> None:
        done, part, waiting, since = self._state()
        if batch_id <= done:
            return
        _lines(logs)[0].write.mode("overwrite").parquet(f"{self.path}/open/batch={batch_id}")
        waiting += _measured(self.spark.read.parquet(f"{self.path}/open/batch={batch_id}"))[1]
        self._commit(batch_id, part, waiting, since, waiting >= self.roll_bytes)

    def finish(self) -> None:
        """Closes the open part; rows that come later begin another."""
        done, part, waiting, since = self._state()
        if waiting:
            self._commit(done + 1, part, waiting, since, True)

    def _commit(self, batch_id: int, part: int, waiting: int, since: int, close: bool) -> None:
        spark, closed = self.spark, []
        if close:
            lines = spark.read.parquet(f"{self.path}/open").where(F.col("batch").between(since, batch_id)).drop("batch")
            order = [c for c in lines.columns if c != "value"]
            tasks = max(1, min(waiting // self.roll_bytes, max(spark.sparkContext.defaultParallelism, waiting // TASK_BYTES)))
            for name in names_in(spark, f"{self.path}/parts"):
                if name.startswith("part=") and int(name.removeprefix("part=")) >= part:  # of a try that did not end
                    remove(spark, f"{self.path}/parts/{name}")
            dealt = materialize(_placed(lines.repartitionByRange(tasks, *order).sortWithinPartitions(*order)), "session-parts")  # bounds of ranges are sampled
            size, cuts, after = F.octet_length("value") + 1, [], 0
            for r in dealt.groupBy("_task").agg(F.sum(size).alias("bytes")).orderBy("_task").collect():  # a row a task, cut into parts of equal bytes
                n = max(1, r["bytes"] // self.roll_bytes)
                cuts.append((r["_task"], after, n, r["bytes"]))
                after += n
            cuts = spark.createDataFrame(cuts, "_task int, _first long, _n long, _bytes long")
            cut = dealt.join(F.broadcast(cuts), "_task").withColumn("_cut", F.expr("_first + _start * _n div _bytes"))
            sums = cut.groupBy("_cut").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))
            found = sums.orderBy("_cut").collect()  # a row a part; cuts that a long line leaves empty make no gap
            number = {r["_cut"]: f"{part + k:04d}" for k, r in enumerate(found)}
            names = spark.createDataFrame(list(number.items()), "_cut long, part string")
            cut.join(F.broadcast(names), "_cut").sortWithinPartitions("part", *order).select("value", "part").write.mode("append").partitionBy("part").text(f"{self.path}/parts")
            closed = [(number[r["_cut"]], *r[1:], 0, batch_id + 1) for r in found]
            drop(dealt)
        rows = closed or [(None, 0, 0, None, None, waiting, since)]
        spark.createDataFrame(rows, _PARTS.rpartition(",")[0]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")
        if close:
            for name in names_in(spark, f"{self.path}/open"):
                if name.startswith("batch=") and since <= int(name.removeprefix("batch=")) <= batch_id:
                    remove(spark, f"{self.path}/open/{name}")
