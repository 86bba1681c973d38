"""Line splitting, reordering, staleness, rolling points and overload detection on streams, with state per key.

They use no watermark, staleness aside: late rows must stay. Time is the newest timestamp that a key has seen. What is still held when a stream
ends is let go by an end row: one whose ``is_end`` is true. Spark wants the RocksDB state store for these operators
(see ``state_store``).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomlog.functions import text as T

#: Buckets of the time for which ``reorder_stream`` holds rows.
_BUCKETS = 64
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """While it is open, streams that start use the RocksDB state store; then the session's setting is as before."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _packed(chunks: DataFrame) -> DataFrame:
    """The chunks of a source that lie in one Arrow batch as one row, ``source, chunk_seq, timestamp_ns, payload`` with arrays: rows cost more on their way to a state than what is in them."""

    def run(batches):
        for batch in batches:
            codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            if not len(order):
                continue
            first = np.flatnonzero(np.diff(codes[order], prepend=-1))
            rows, ends = batch.take(pa.array(order)), pa.array([*first, len(order)], pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first)), *(pa.ListArray.from_arrays(ends, rows.column(k)) for k in (1, 2, 3))], names=batch.schema.names)

    return chunks.mapInArrow(run, "source string, chunk_seq array<long>, timestamp_ns array<long>, payload array<binary>")


_LINES = "source string, line_no long, timestamp_ns long, raw binary"


class _Lines(StatefulProcessor):
    def __init__(self, sep: int):
        self.sep = bytes([sep])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.line = handle.getValueState("line", "line_no long")
        self.tail = handle.getListState("tail", "piece binary")  # of a line not ended; a batch adds to it

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        line_no = self.line.get()[0] if self.line.exists() else 0
        packs = pd.concat(list(rows))
        place, times, payloads = (np.concatenate([np.asarray(x, kind) for x in packs[c]]) for c, kind in (("chunk_seq", np.int64), ("timestamp_ns", np.int64), ("payload", object)))
        order = np.argsort(place, kind="stable")
        chunks = list(zip(times[order].tolist(), payloads[order], strict=True))
        ends = any(self.sep in bytes(x) for _, x in chunks)
        before = [bytes(x[0]) for x in self.tail.get()] if ends and self.tail.exists() else []  # read only when its line ends
        held, out = before, []
        for ns, payload in chunks:
            first, *others = bytes(payload).split(self.sep)
            held.append(first)
            for piece in others:
                if line := b"".join(held):
                    out.append((key[0], line_no, ns, line))
                held, line_no = [piece], line_no + 1
        rest = b"".join(held)
        if ends:
            self.tail.put([(rest,)]) if rest else self.tail.clear()
        elif rest:
            self.tail.appendValue((rest,))
        self.line.update((line_no,))
        yield pd.DataFrame(out, columns=["source", "line_no", "timestamp_ns", "raw"])

    def close(self) -> None:
        pass


def split_lines_stream(chunks: DataFrame, sep: int = 10) -> DataFrame:
    """As ``split_lines``; a source's state is its unterminated rest and the number of its next line."""
    return _packed(chunks.select("source", "chunk_seq", "timestamp_ns", "payload")).groupBy("source").transformWithStateInPandas(_Lines(sep), _LINES, "append", "none")


_ROWS = "device string, timestamp_ns long, module string, level int, message string"


class _Reorder(StatefulProcessor):
    """Held rows lie in buckets by time, as pieces that are written once: a batch touches what it brings and what is due, however much is held.

    Nothing older than the newest row less the delay is held, so there are about ``_BUCKETS`` buckets.
    """

    def __init__(self, delay_ns: int):
        self.delay_ns, self.width = delay_ns, max(1, delay_ns // _BUCKETS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "newest long, released long")
        self.open = handle.getValueState("open", "buckets binary")  # bucket: (its first piece, the number after its last)
        self.pieces = handle.getMapState("pieces", "bucket long, piece long", "rows binary")

    def _taken(self, bucket: int, first: int, end: int) -> list[tuple]:
        rows = []
        for piece in range(first, end):
            rows += pickle.loads(self.pieces.getValue((bucket, piece))[0])
            self.pieces.removeKey((bucket, piece))
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["timestamp_ns", "module", "level", "message"]
        new = pd.concat(list(rows))
        end = bool(new["is_end"].any())
        new = new[~new["is_end"]]
        newest, released = self.seen.get() if self.seen.exists() else (-(1 << 62), -(1 << 62))
        newest = max(newest, int(new["timestamp_ns"].max())) if len(new) else newest
        due = max(newest - self.delay_ns, released - 1)  # later rows stay, unless all end
        held: dict[int, tuple[int, int]] = pickle.loads(self.open.get()[0]) if self.open.exists() else {}
        go: list[tuple] = []
        for bucket in sorted(held):
            if end or bucket * self.width <= due:
                go += self._taken(bucket, *held.pop(bucket))
        go += new[columns].itertuples(index=False, name=None)
        stay: dict[int, list[tuple]] = {}
        if not end:
            for row in go:
                if row[0] > due:
                    stay.setdefault(row[0] // self.width, []).append(row)
            go = [row for row in go if row[0] <= due]
        for bucket, own in stay.items():
            first, after = held.get(bucket, (0, 0))
            self.pieces.updateValue((bucket, after), (pickle.dumps(own),))
            held[bucket] = first, after + 1
        out = pd.DataFrame(go, columns=columns).sort_values("timestamp_ns", kind="stable")
        late = out["timestamp_ns"] < released
        if len(out):
            released = max(released, int(out["timestamp_ns"].max()))
        self.seen.update((newest, released))
        self.open.update((pickle.dumps(held),))
        yield out.assign(device=key[0], is_late=late)[["device", *columns, "is_late"]]

    def close(self) -> None:
        pass


def reorder_stream(logs: DataFrame, delay_ms: int = 100) -> DataFrame:
    """Rows of each device in order of time once they are older than the newest less the delay; ``is_late`` marks rows that came after their turn.

    Late rows are never dropped; ties keep the order they came in. ``logs`` may have a boolean ``is_end``.
    """
    rows = logs if "is_end" in logs.columns else logs.withColumn("is_end", F.lit(False))
    rows = rows.select("device", "timestamp_ns", "module", "level", "message", "is_end")
    return rows.groupBy("device").transformWithStateInPandas(_Reorder(delay_ms * 1_000_000), f"{_ROWS}, is_late boolean", "append", "none")


class _Stale(StatefulProcessor):
    def __init__(self, threshold_ns: int):
        self.threshold_ns = threshold_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "newest_ns long, stale boolean")

    def _out(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=["device", "module", "newest_ns", "stale", "at_ns"])

    def _due_ms(self, newest: int) -> int:
        return (newest + self.threshold_ns) // 1_000_000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        times = sorted(map(int, new.loc[~new["is_tick"], "timestamp_ns"]))
        if not times:
            return
        newest, stale = self.newest.get() if self.newest.exists() else (None, True)
        out = []
        for ns in times:
            if newest is not None and not stale and ns - newest > self.threshold_ns:
                out.append((newest, True, newest + self.threshold_ns))
                stale = True
            if newest is None or ns > newest:
                newest = ns
                if stale:
                    out.append((newest, False, ns))
                    stale = False
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(self._due_ms(newest))
        self.newest.update((newest, stale))
        yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, stale = self.newest.get()
        if not stale and self._due_ms(newest) <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.update((newest, True))
            yield self._out(key, [(newest, True, newest + self.threshold_ns)])

    def close(self) -> None:
        pass


def staleness_stream(logs: DataFrame, threshold_s: float = 30, late: str = "0 seconds") -> DataFrame:
    """``device, module, newest_ns, stale, at_ns``: a row when a module's first row comes or one after a gap (fresh from ``at_ns`` on) and one when it turns stale (after ``at_ns``).

    A module turns stale without a row of its own: event time goes on with the rows of others and with tick rows, those whose boolean ``is_tick`` is true, by a timer of each
    module. At any time that the stream has passed, the last change before it says what ``staleness`` says. Rows older than the newest of all less ``late`` are dropped.
    """
    rows = logs if "is_tick" in logs.columns else logs.withColumn("is_tick", F.lit(False))
    rows = rows.select("device", "module", "timestamp_ns", "is_tick", F.expr("timestamp_micros(timestamp_ns div 1000)").alias("ts")).withWatermark("ts", late)
    schema = "device string, module string, newest_ns long, stale boolean, at_ns long"
    return rows.groupBy("device", "module").transformWithStateInPandas(_Stale(int(threshold_s * 1e9)), schema, "append", "eventtime")


class _Ring(StatefulProcessor):
    def __init__(self, max_points: int):
        self.max_points = max_points

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "points array<long>")  # of each channel; their number is that of the first row

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        counts = list(self.counts.get()[0]) if self.counts.exists() else [0] * len(new["numbers"].iloc[0])
        out: dict[tuple[int, int], tuple] = {}
        for seq, ns, numbers in zip(new["seq"], new["timestamp_ns"], new["numbers"], strict=True):
            for channel, value in enumerate(numbers[: len(counts)]):
                slot = counts[channel] % self.max_points
                out[channel, slot] = (*key, channel, slot, int(seq), int(ns), float(value))  # a slot filled twice in a batch is given once
                counts[channel] += 1
        self.counts.update((counts,))
        yield pd.DataFrame(list(out.values()), columns=["device", "module", "channel", "slot", "seq", "timestamp_ns", "value"])

    def close(self) -> None:
        pass


def rolling_points_stream(logs: DataFrame, max_points: int = 10_000) -> DataFrame:
    """``numeric_series`` and ``rolling_points`` of a stream: ``device, module, channel, slot, seq, timestamp_ns, value``, the points that a batch brings.

    Each module and channel is a ring of ``max_points`` slots; a point takes the place of the one that left, so a sink that overwrites by device, module, channel and slot
    holds the newest points, and ``rolled_points`` reads them from a log of the changes. State is a count a channel; a module's first row with a number fixes its channels.
    Rows of a module must come in the order of ``seq``.
    """
    rows = logs.select("device", "module", "seq", "timestamp_ns", T.extract_numbers(F.col("message")).alias("numbers")).where("size(numbers) > 0")
    schema = "device string, module string, channel int, slot int, seq long, timestamp_ns long, value double"
    return rows.groupBy("device", "module").transformWithStateInPandas(_Ring(max_points), schema, "append", "none")


def rolled_points(changes: DataFrame) -> DataFrame:
    """``device, module, channel, seq, timestamp_ns, value`` of the points in their slots, from all that ``rolling_points_stream`` gave."""
    last = changes.groupBy("device", "module", "channel", "slot").agg(F.max(F.struct("seq", "timestamp_ns", "value")).alias("p"))
    return last.select("device", "module", "p.seq", "p.timestamp_ns", "channel", "p.value")


class _Overload(StatefulProcessor):
    def __init__(self, limit: int, burst: int, cap: int):
        self.limit, self.burst, self.cap = limit, burst, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "second long, rows long, start long, told long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        second, n, start, told = self.open.get() if self.open.exists() else (-1, 0, -1, -1)
        counts = pd.concat(list(rows)).groupby("second").size().sort_index()
        out = []
        for now, more in counts.items():
            if now < second:
                continue  # its window is closed
            if now > second:
                if n <= self.limit or now > second + 1:
                    start = -1
                second, n = int(now), 0
            n += int(more)
            if n > self.limit and start < 0:
                start = second
            if start >= 0 and n > self.limit and told != start and (n > self.cap or second - start >= self.burst):
                told = start
                out.append((key[0], start, second, n))
        self.open.update((second, n, start, told))
        yield pd.DataFrame(out, columns=["viewer", "start_s", "trigger_s", "rows"])

    def close(self) -> None:
        pass


def overload_stream(logs: DataFrame, viewer_col: str, limit_per_sec: int = 1000, burst_seconds: int = 3, instant_cap: int = 5000) -> DataFrame:
    """A row when a viewer's run of seconds over the limit first triggers a pause (see ``overload_periods``); seconds must come in order."""
    rows = logs.select(F.col(viewer_col).cast("string").alias("viewer"), F.expr("timestamp_ns div 1000000000").alias("second"))
    return rows.groupBy("viewer").transformWithStateInPandas(_Overload(limit_per_sec, burst_seconds, instant_cap), "viewer string, start_s long, trigger_s long, rows long", "append", "none")
