"""One stream to many sinks."""

from __future__ import annotations

import logging
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from loomlog.storage import mark, names_in, remove

Sink = Callable[[DataFrame, int], None]


def fan_out(sinks: dict[str, Sink]) -> Sink:
    """A function for ``foreachBatch`` that gives each batch to every sink; a sink that fails does not keep it from the others, and the batch fails after all ran.

    The stream stops with the batch, and all sinks get it again; ``FanOut`` goes on without the one that fails.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        failed = {}
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, batch_id)
                except Exception as error:  # told below, after the other sinks
                    failed[name] = error
        finally:
            batch.unpersist()
        if failed:
            raise RuntimeError("; ".join(f"{name}: {error}" for name, error in failed.items()))

    return run


class FanOut:
    """For ``foreachBatch``: every sink gets every batch in order, and a sink that fails catches up later while the stream and the other sinks go on.

    Each batch is written below ``path`` first. A ledger holds the last batch that each sink has taken; with every batch, and in ``catch_up``, a sink is given
    what it lacks, oldest first, and its first failure ends its turn. Batches that all have taken go. A batch that Spark runs again is
    given to those sinks only that lack it. A sink that dies between its work and its entry gets the batch again under the same number, so sinks
    should overwrite by number, as for any ``foreachBatch``. Once a sink is more than ``most_behind`` batches behind, the batch fails and the stream stops.

    The sinks of a ledger may change between runs: a new one begins with the oldest batch still kept.
    """

    def __init__(self, sinks: dict[str, Sink], path: str, most_behind: int = 1_000):
        self.sinks, self.path, self.most_behind = sinks, path.rstrip("/"), most_behind

    def _taken(self, spark: SparkSession, name: str) -> int:
        """The last batch that a sink has taken, -1 for none."""
        return max(map(int, names_in(spark, f"{self.path}/ledger/{quote(name, safe='')}")), default=-1)

    def _kept(self, spark: SparkSession) -> list[int]:
        """The batches written whole, oldest first."""
        return sorted(map(int, names_in(spark, f"{self.path}/kept")))

    def _take(self, spark: SparkSession, name: str, batch_id: int) -> None:
        at = f"{self.path}/ledger/{quote(name, safe='')}"
        before = names_in(spark, at)
        mark(spark, f"{at}/{batch_id}")
        for old in before:
            if int(old) < batch_id:
                remove(spark, f"{at}/{old}")

    def behind(self, spark: SparkSession) -> dict[str, list[int]]:
        """The batches that each sink lacks; only sinks that lack some."""
        kept = self._kept(spark)
        lacks = {name: [b for b in kept if b > self._taken(spark, name)] for name in self.sinks}
        return {name: some for name, some in lacks.items() if some}

    def catch_up(self, spark: SparkSession) -> dict[str, Exception]:
        """Gives each sink what it lacks; the errors of those that failed again."""
        failed = {}
        for name, lacks in self.behind(spark).items():
            for batch_id in lacks:
                try:
                    self.sinks[name](spark.read.parquet(f"{self.path}/batches/{batch_id}"), batch_id)
                except Exception as error:  # this sink waits for its next turn, the others do not
                    logging.getLogger(__name__).warning("sink %s failed at batch %d: %s", name, batch_id, error)
                    failed[name] = error
                    break
                self._take(spark, name, batch_id)
        done = min((self._taken(spark, name) for name in self.sinks), default=-1)
        for batch_id in self._kept(spark):
            if batch_id <= done:
                remove(spark, f"{self.path}/kept/{batch_id}")
                remove(spark, f"{self.path}/batches/{batch_id}")
        return failed

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if any(self._taken(spark, name) < batch_id for name in self.sinks) and batch_id not in self._kept(spark):
            batch.write.mode("overwrite").parquet(f"{self.path}/batches/{batch_id}")
            mark(spark, f"{self.path}/kept/{batch_id}")
        failed = self.catch_up(spark)
        late = {name: lacks for name, lacks in self.behind(spark).items() if len(lacks) > self.most_behind}
        if late:
            raise RuntimeError("; ".join(f"{name} is {len(lacks)} batches behind: {failed.get(name)}" for name, lacks in late.items()))
