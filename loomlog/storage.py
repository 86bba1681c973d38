"""Tables written between jobs: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
#: The tables written inside each open ``passing`` of this thread, innermost last.
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one if all runs on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="loomlog-"))
    return _own_dir[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; all of one application's lie below one directory."""
    return f"{shared_dir(spark)}/loomlog-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """The file system of a path and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    files, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    files, at = _at(spark, path)
    files.create(at, True).close()


def remove(spark: SparkSession, path: str) -> None:
    _remove(spark, path)


def drop_scratch(spark: SparkSession) -> None:
    """Removes what this application has put in the shared folder. Results that are still lazy need it."""
    _remove(spark, f"{shared_dir(spark)}/loomlog-{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _open.get():
        _open.get()[-1].append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``materialize`` wrote and that nothing lazy needs any more; others are left alone."""
    for df in tables:
        path = df.__dict__.pop("_scratch_path", None)
        if path:
            _remove(df.sparkSession, path)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is materialized inside goes at the end, save what ``keep`` was called on: for steps whose result is written before they end.

    >>> with passing() as keep:
    ...     result = keep(materialize(step(docs), "result"))
    """
    made: list[DataFrame] = []
    kept: set[int] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    before = _open.get()
    _open.set((*before, made))
    try:
        yield keep
    finally:
        _open.set(before)
        drop(*[x for x in made if id(x) not in kept])
        if before:
            before[-1].extend(x for x in made if id(x) in kept)
