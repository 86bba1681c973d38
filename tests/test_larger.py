"""Registered queries on tables that the small ones do not stand for: keys beyond 16 bits, several files, many parts."""


import os

import duckdb
import pytest

from loomlog import queries
from loomlog.plans import tables
from loomlog.sources import session_log
from loomlog.streaming import stateful
from tests.test_queries import plain

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, path, rows, files=1):
    """A folder with a table of events in so many files, each with events of all times."""
    df = spark.createDataFrame(rows, EVENTS).repartition(1).cache()
    for k in range(files):
        df.where(f"event_id % {files} = {k}").coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return str(path)


def made(spark, n):
    """Events over an hour, of users from 0 on."""
    return spark.range(n).selectExpr(
        "id as event_id", f"cast(timestamp_millis(1700000000000 + id * 3600000 div {n}) as timestamp_ntz) as ts", "id * 7 as user_id",
        "element_at(array('error', 'purchase', 'signup', 'click', 'view'), cast(id % 5 + 1 as int)) as event_type", "double(id % 97) as value", "concat('{\"k\": ', id % 100, '}') as props",
    ).collect()


def differ(spark, name, path):
    """Rows of the query and of its SQL that the other lacks."""
    df = queries.queries()[name](spark, path)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    want = sorted(repr(tuple(map(plain, r))) for r in con.sql(queries.oracle_sql()[name]).select(", ".join(f'"{c}"' for c in columns)).fetchall())
    return [] if got == want else sorted(set(got) ^ set(want))[:6] or [len(got), len(want)]


@pytest.mark.parametrize("name", ["n1_decode_signals", "n1_multiplexed", "n2_unmapped_policy", "n3_signals_to_logs", "n4_frames_to_logs", "s6_rx_dump"])
def test_frames_have_eight_bytes_whatever_the_keys(spark, tmp_path, name):
    rows = [(k, r["ts"], user, r["event_type"], cents / 100, r["props"]) for r, (k, user, cents) in zip(made(spark, 9), [
        (0, 7, 1), (1, 65_535, 2), (2, 65_536, 3), (3, 89_999, 4), (4, 1 << 24, 5), (5, 1 << 40, 6), (6, 70_000, 1 << 33), (7, 70_001, (1 << 32) + 9), (8, 3, 56_021)], strict=True)]
    path = events(spark, tmp_path, rows)
    frames = tables.frames(spark, path)
    assert {len(r["data"]) for r in frames.collect()} == {8}
    assert differ(spark, name, path) == []


@pytest.mark.parametrize("files", [3, 5])
@pytest.mark.parametrize("name", ["a6_staleness_stream", "c2_stream_topology", "t3_rolling_stream"])
def test_batches_of_streams_do_not_depend_on_files(spark, tmp_path, name, files):
    """With three files a part of time, batches of four files mixed times: rows were late or numbered out of order."""
    path = events(spark, tmp_path, made(spark, 400), files)
    assert differ(spark, name, path) == []


def test_dropped_rows_lie_in_as_many_files_as_tasks(spark, tmp_path):
    """Six files whatever the input made one task read a sixth of it; a stream still gets three batches."""
    for tasks, files in ((1, 6), (12, 12), (20, 20)):
        path = str(tmp_path / str(tasks))
        each = queries._in_thirds(spark.range(0, 6000, 1, tasks), path)
        assert len([x for x in os.listdir(path) if x.startswith("part-")]) == files and -(-files // each) == 3


def test_chunks_of_a_source_go_to_its_state_together(spark):
    schema = "source string, chunk_seq long, timestamp_ns long, payload binary"
    rows = [(("a", "b", None)[k % 3], k, 10 * k, b"%d\n" % k) for k in range(300)]
    packed = stateful._packed(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    assert sorted(str(r["source"]) for r in packed) == ["None", "a", "b"]
    back = sorted((k, r["source"], ns, bytes(p)) for r in packed for k, ns, p in zip(r["chunk_seq"], r["timestamp_ns"], r["payload"], strict=True))
    assert back == [(k, source, ns, p) for source, k, ns, p in rows]
    assert stateful._packed(spark.createDataFrame([], schema)).collect() == []


def test_a_task_writes_many_session_parts(spark, tmp_path, monkeypatch):
    """Parts had a task each, and a list of all their names was searched for every line."""
    tasks, write = [], session_log.materialize

    def seen(df, name):
        tasks.append(df.rdd.getNumPartitions())
        return write(df, name)

    monkeypatch.setattr(session_log, "materialize", seen)
    logs = spark.range(2000).selectExpr("id as seq", "1000 * id as timestamp_ns", "'d' as device", "'m' as module", "20 as level", "case id when 700 then repeat('x', 3000) else lpad(id, 20, '0') end as message")
    parts = session_log.SessionParts(spark, str(tmp_path), 1_000)
    parts.add(logs, 0)
    found = parts.manifest().orderBy("part").collect()
    assert tasks and max(tasks) <= spark.sparkContext.defaultParallelism < len(found) / 10
    assert [r["part"] for r in found] == [f"{k:04d}" for k in range(len(found))] and sum(r["rows"] for r in found) == 2000
    assert all(r["bytes"] < 2_000 + 3_100 for r in found) and sum(r["bytes"] for r in found) == 2000 * 56 + 2_980
    for r in found[:: len(found) // 5]:  # a part is what its entry says, in order of time
        lines = [line for x in sorted((tmp_path / "parts" / f"part={r['part']}").glob("part-*")) for line in x.read_text().splitlines()]
        assert len(lines) == r["rows"] and lines == sorted(lines)
    assert sorted(r["timestamp_ns"] for r in session_log.read_log_text(spark, str(tmp_path / "parts")).collect()) == [1000 * k for k in range(2000)]
