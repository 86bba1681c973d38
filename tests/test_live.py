"""Topologies, sinks, ids and stored logs that live over batches."""

import random

import pytest

from loomlog.operators import filters, latest, render, series, text_index
from loomlog.operators.filters import LogFilter
from loomlog.plans import pipeline
from loomlog.sources import session_log
from loomlog.sources.log_store import LogStore
from loomlog.streaming import stateful
from loomlog.streaming.fan_out import FanOut
from loomlog.streaming.registry import Registry
from tests.test_streaming import files, run

LOGS = "seq long, timestamp_ns long, device string, module string, level int, message string"


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_a_stream_topology_keeps_lines_over_batches(spark, tmp_path):
    schema = "source string, chunk_seq long, timestamp_ns long, payload binary"
    data = b"x=1 one\ny=2 two\nz=3, w=4 three\nlast=5\n"
    chunks = [("s", k, 10 + k, data[i : i + 6]) for k, i in enumerate(range(0, len(data), 6))]
    spec = {"main": {"type": "default", "device": "d", "sources": ["in"]}, "values": {"type": "key_value", "device": "kv", "sources": ["main"]}}
    stream = files(spark, tmp_path, [chunks[:2], chunks[2:4], chunks[4:]], schema)
    seen = []
    query = pipeline.start_topology(spec, {"in": stream}, str(tmp_path / "out"), subscribers=lambda batch, n: seen.append((n, batch.count())))
    query.trigger(availableNow=True).start().awaitTermination(240)
    got = LogStore(spark, str(tmp_path / "out")).rows()
    want = pipeline.run_topology(spec, {"in": spark.createDataFrame(chunks, schema)})
    columns = ("seq", "timestamp_ns", "device", "module", "message")
    assert tuples(got, *columns) == tuples(want, *columns)
    assert [n for n, _ in seen] == [0, 1, 2] and sum(c for _, c in seen) == got.count()


def test_a_topology_may_mix_inputs_and_pipelines(spark):
    logs = spark.createDataFrame([(1, "a", "m", 20, "k=1"), (2, "b", "m", 20, "k=2")], "timestamp_ns long, device string, module string, level int, message string")
    records = spark.createDataFrame([(3, 20, "n", "k=3")], "created_ns long, levelno int, name string, msg string")
    spec = {"main": {"type": "records", "device": "r", "sources": ["rec"]}, "values": {"type": "key_value", "device": "kv", "sources": ["log", "main"]}}
    stream, rest = pipeline.stream_topology(spec, {"rec": records, "log": logs})
    done = rest(stream)
    assert tuples(done["values"], "timestamp_ns", "message") == [(1, "1"), (2, "2"), (3, "3")]
    assert tuples(done["main"], "message") == [("k=3",)]
    with pytest.raises(ValueError, match="unknown sources"):
        pipeline.stream_topology({"values": {"type": "key_value", "device": "kv", "sources": ["none"]}}, {"log": logs})


def test_a_sink_that_fails_twice_catches_up(spark, tmp_path):
    got = {"good": [], "bad": []}
    fails = iter([1, 1])

    def bad(batch, n):
        if next(fails, None):
            raise OSError("down")
        got["bad"].append((n, batch.count()))

    path = str(tmp_path / "ledger")
    sinks = {"good": lambda b, n: got["good"].append((n, b.count())), "bad/": bad}
    for n in range(2):
        FanOut(sinks, path)(spark.range(n + 1), n)  # a new process each time
    assert got == {"good": [(0, 1), (1, 2)], "bad": []}
    assert FanOut(sinks, path).behind(spark) == {"bad/": [0, 1]}
    FanOut(sinks, path)(spark.range(2), 1)  # Spark runs the batch again
    assert got == {"good": [(0, 1), (1, 2)], "bad": [(0, 1), (1, 2)]}
    FanOut(sinks, path)(spark.range(2), 1)
    FanOut(sinks, path)(spark.range(3), 2)
    assert got == {"good": [(0, 1), (1, 2), (2, 3)], "bad": [(0, 1), (1, 2), (2, 3)]}
    assert FanOut(sinks, path).behind(spark) == {} and not list((tmp_path / "ledger" / "batches").iterdir())


def test_a_sink_too_far_behind_stops_the_stream(spark, tmp_path):
    def bad(batch, n):
        raise OSError("down")

    sinks = FanOut({"bad": bad}, str(tmp_path / "ledger"), most_behind=2)
    sinks(spark.range(1), 0)
    sinks(spark.range(1), 1)
    with pytest.raises(RuntimeError, match="bad is 3 batches behind: down"):
        sinks(spark.range(1), 2)


def test_registered_ids_never_change(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(s, d, m) for s, d, m in x], "seq long, device string, module string")
    registry = Registry(spark, str(tmp_path / "ids"))
    assert registry.modules().count() == 0
    registry.add(rows((10, "B", "x.y"), (11, "b", "z"), (12, None, "q"), (13, "b", None)), 0)
    first = tuples(registry.modules(), "device", "module", "module_id")
    assert first == [("b", "", 0), ("b", "x", 1), ("b", "x.y", 2), ("b", "z", 3)]
    registry.add(rows((1, "a", "m"), (2, "b", "x.a.b"), (3, "b", "x.y")), 1)  # earlier rows renumber nothing
    again = tuples(registry.modules(), "device", "module", "module_id")
    assert set(first) < set(again) and set(again) - set(first) == {("a", "", 0), ("a", "m", 1), ("b", "x.a", 4), ("b", "x.a.b", 5)}
    assert tuples(registry.devices(), "device", "device_id") == [("a", 1), ("b", 0)]
    registry.add(rows((1, "a", "m"), (2, "b", "x.a.b"), (3, "b", "x.y")), 1)  # a batch that comes again
    registry.add(rows(), 2)
    assert tuples(registry.modules(), "device", "module", "module_id") == again
    assert tuples(registry.with_ids(rows((1, "B", "z"), (2, "c", "z"))), "seq", "device_id", "module_id") == [(1, 0, 3), (2, None, None)]


def test_newest_probes_the_end_of_the_table(spark, tmp_path):
    logs = spark.range(4000).selectExpr("id + 1 as k", "id as timestamp_ns", "concat('d', id % 3) as device", "'m' as module", "cast(if(id % 100 = 0, 40, 20) as int) as level", "cast(id as string) as message")
    store = LogStore(spark, str(tmp_path / "store"), ("timestamp_ns",))
    for n in range(4):
        store.append(logs.where(f"timestamp_ns div 1000 = {n}"), n)
    store.append(logs.where("timestamp_ns div 1000 = 3"), 3)
    assert store.last_seq() == 4000
    for log_filter, total, after in ((LogFilter(), 20, 0), (LogFilter(level="ERROR"), 20, 0), (LogFilter(level="ERROR", device="d1"), 50, 0), (LogFilter(), 20, 3990), (LogFilter(device="none"), 5, 0)):
        got = store.newest(log_filter, total, after)
        want = render.tail(store.rows(), log_filter, total, after)
        assert [tuple(r) for r in got.select("seq", "message").collect()] == [tuple(r) for r in want.select("seq", "message").collect()]
    plan = store.newest(LogFilter(), 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(seq,3840)" in plan
    assert store.newest(LogFilter(), 0).count() == 0 and LogStore(spark, str(tmp_path / "none")).newest(LogFilter(), 5).count() == 0


def test_levels_of_modules_not_known(spark, tmp_path):
    rows = [(1, 1, "d", "known", 20, "a"), (2, 2, "d", "new", 20, "b"), (3, 3, "d", "new", 50, "c"), (4, 4, "d", None, 50, "d"), (5, 5, None, "x", 5, "e"), (6, 6, "d", "known", 40, "f")]
    logs = spark.createDataFrame(rows, LOGS)
    overrides = spark.createDataFrame([("d", "known", True, 40)], "device string, module string, enabled boolean, level int")
    known = spark.createDataFrame([("d", "known")], "device string, module string")
    got = lambda df: sorted(r["seq"] for r in df.collect())
    assert got(filters.filter_module_levels(logs, overrides, "ALL", known)) == [2, 3, 4, 5, 6]
    assert got(filters.filter_module_levels(logs, overrides, "ERROR", known)) == [3, 4, 6]
    assert got(filters.filter_module_levels(logs, overrides, "OFF", known)) == [6]
    assert got(filters.filter_module_levels(logs, overrides, "ERROR")) == [3, 4, 6]
    stream = filters.filter_module_levels(files(spark, tmp_path, [rows[:3], rows[3:]], LOGS), overrides, "ERROR", known)
    stream.writeStream.format("memory").queryName("not_known").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(240)
    assert got(spark.table("not_known")) == [3, 4, 6]


def test_changes_of_null_modules(spark):
    rows = [(1, 1, "d", None, 20, "a"), (2, 2, "d", None, 20, "a"), (3, 3, "d", None, 20, "b"), (4, 4, None, None, 20, "b"), (5, 5, None, "m", 20, None), (6, 6, None, "m", 20, None)]
    logs = spark.createDataFrame(rows, LOGS)
    assert sorted(r["seq"] for r in latest.value_changes(logs, block=2).collect()) == [1, 3, 4, 5, 6]
    assert tuples(latest.last_change(logs), "device", "module", "seq") == [("d", None, 3), (None, "m", 6), (None, None, 4)]


def test_messages_with_line_ends_round_trip(spark, tmp_path):
    messages = ["a\nb", "a\\nb", "\\", "\\\\n\n\\", "\r\n", "C:\\new\\right", "", "plain", "\\\\\\n"]
    logs = spark.createDataFrame([(k, 1_000 * k, "d", "m", 20, m) for k, m in enumerate(messages)], LOGS)
    session_log.write_session_log(logs, str(tmp_path / "s"))
    got = session_log.read_log_text(spark, str(tmp_path / "s"))
    assert [r["message"] for r in got.orderBy("timestamp_ns").collect()] == messages and got.where("_error is not null").count() == 0
    line = spark.createDataFrame([("2024-01-01T00:00:00.000000Z I d m: C:\\new",)], "line string")
    assert session_log.parse_session_lines(line, escaped=False).first()["message"] == "C:\\new"


def test_parts_roll_over_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    rows = lambda a, b: spark.createDataFrame([(k, 1_000 * k, "d", "m", 20, f"{k:020d}") for k in range(a, b)], LOGS)
    writer = lambda: session_log.SessionParts(spark, path, 3_000)  # noqa: E731  one a process; a line has 56 bytes
    for n in range(7):
        writer().add(rows(10 * n, 10 * n + 10), n)
        writer().add(rows(10 * n, 10 * n + 10), n)  # comes again
    assert [(r["part"], r["rows"]) for r in writer().manifest().orderBy("part").collect()] == [("0000", 60)]
    assert [x.name for x in (tmp_path / "s" / "open").iterdir()] == ["batch=6"]
    commit = session_log.remove
    monkeypatch.setattr(session_log.SessionParts, "_commit", lambda *x: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        writer().add(rows(70, 300), 7)
    monkeypatch.undo()
    assert session_log.remove is commit
    writer().add(rows(70, 300), 7)  # a large batch: 60 to 300 are about 13 kB
    writer().add(rows(300, 305), 8)
    writer().finish()
    writer().finish()
    found = [(r["part"], r["rows"], r["bytes"], r["first_ns"]) for r in writer().manifest().orderBy("part").collect()]
    assert [x[0] for x in found] == [f"{k:04d}" for k in range(len(found))] and len(found) == 6
    assert sum(x[1] for x in found) == 305 and all(x[2] == 56 * x[1] for x in found) and found[-1][1] == 5
    assert sorted(r["message"] for r in session_log.read_log_text(spark, f"{path}/parts").collect()) == [f"{k:020d}" for k in range(305)]
    assert {x.name for x in (tmp_path / "s" / "parts").iterdir() if x.is_dir()} == {f"part={k:04d}" for k in range(6)}


EVENTS = "device string, timestamp_ns long, module string, level int, message string, is_end boolean"


def test_reorder_holds_much_and_touches_little(spark, tmp_path):
    """Many rows held in many batches, ties, late rows; the order is that of a plain pass."""
    rng = random.Random(1)
    second = 1_000_000_000
    batches, newest, n = [], 0, 0
    for _ in range(8):
        rows = []
        for _ in range(40):
            newest += rng.randrange(second // 4)
            n += 1
            rows.append(("d", max(0, newest - rng.randrange(3 * second)), "m", 20, str(n), False))
        batches.append(rows)
    got = [(r["timestamp_ns"], r["message"], r["is_late"]) for r in run(stateful.reorder_stream(files(spark, tmp_path, [*batches, [("d", 0, "", 0, "", True)]], EVENTS), 2000), tmp_path).collect()]
    held, top, released, want = [], -(1 << 62), -(1 << 62), []
    for rows in [*batches, None]:
        held += [(r[1], r[4]) for r in rows or ()]
        top = max([top, *(r[1] for r in rows or ())])
        go = sorted([x for x in held if rows is None or x[0] <= top - 2 * second or x[0] < released], key=lambda x: x[0])
        held = [x for x in held if x not in go]
        want += [(*x, x[0] < released) for x in go]
        released = max([released, *(x[0] for x in go)])
    assert sorted(got) == sorted(want) and [x[0] for x in got] == [x[0] for x in want] and any(x[2] for x in want)


def test_modules_turn_stale_without_a_row(spark, tmp_path):
    schema = "device string, module string, timestamp_ns long, is_tick boolean"
    s = 1_000_000_000
    batches = [[("d", "a", 1 * s, False), ("d", "b", 2 * s, False)], [("d", "a", 20 * s, False)], [("", "", 40 * s, True)], [("d", "a", 45 * s, False), ("d", "a", 90 * s, False), ("d", "c", 91 * s, False)], [("", "", 200 * s, True)]]
    changes = run(stateful.staleness_stream(files(spark, tmp_path, batches, schema)), tmp_path).collect()
    assert sorted((r["module"], r["at_ns"] // s, r["stale"]) for r in changes) == [
        ("a", 1, False), ("a", 75, True), ("a", 90, False), ("a", 120, True), ("b", 2, False), ("b", 32, True), ("c", 91, False), ("c", 121, True),
    ]
    logs = spark.createDataFrame([x for b in batches for x in b if not x[3]], schema)
    for tick in (10, 40, 60, 80, 100, 130):
        seen = logs.where(f"timestamp_ns <= {tick * s}")
        want = {r["module"]: r["stale"] for r in latest.staleness(seen, seen.select("device", "module").distinct(), tick * s).collect()}
        before = sorted((r["at_ns"], r["stale"], r["module"]) for r in changes if r["at_ns"] < tick * s or not r["stale"] and r["at_ns"] == tick * s)
        assert {m: stale for _, stale, m in before} == want


def test_rolling_points_over_batches(spark, tmp_path):
    rows = [(k, k, "d", f"m{k % 2}", 20, f"{k} {k / 2} x" if k % 3 else f"{k}") for k in range(1, 60)] + [(60, 60, "d", "n", 20, "none")]
    stream = files(spark, tmp_path, [rows[:7], rows[7:30], rows[30:]], LOGS)
    got = stateful.rolled_points(run(stateful.rolling_points_stream(stream, 5), tmp_path))
    want = series.rolling_points(series.numeric_series(spark.createDataFrame(rows, LOGS)), 5)
    columns = ("device", "module", "seq", "timestamp_ns", "channel", "value")
    assert tuples(got, *columns) == tuples(want, *columns)


def test_search_by_trigrams(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("abAB é.%_") for _ in range(rng.randrange(30)))) for k in range(3000)] + [(3000, "the Rare needle"), (3001, None), (9000, "rare NEEDLE again")]
    spark.createDataFrame(rows, "seq long, line string").repartitionByRange(6, "seq").sortWithinPartitions("seq").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    text_index.write_trigrams(lines, str(tmp_path / "index"), 100)
    index = spark.read.parquet(str(tmp_path / "index"))
    for needle in ("rare needle", "aba", "b.", "é a", "A%_", "zzz", " ", "abab"):
        got = text_index.find_indexed(lines, index, needle, 100)
        assert tuples(got, "seq", "position") == tuples(filters.find_text(lines, needle), "seq", "position")
    plan = text_index.find_indexed(lines, index, "Rare needle", 100)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(seq,3000)" in plan and "LessThan(seq,3100)" in plan
    assert {r["block"] for r in text_index.candidate_blocks(index, "rare needle").collect()} == {30, 90}
