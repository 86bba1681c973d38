"""Streams give what the batch operators give."""

import itertools

import pytest
from loomlog.operators import latest, lines, order
from loomlog.plans import pipeline
from loomlog.sources.stream import stream_chunks
from loomlog.streaming import stateful
from loomlog.streaming.fan_out import fan_out

LOGS = "device string, timestamp_ns long, module string, level int, message string, is_end boolean"
_names = itertools.count()


def files(spark, path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        _touch(path, k)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def _touch(path, k):
    import os

    for f in (path / "in").iterdir():
        if f.suffix == ".parquet" and not f.name.startswith("k"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
            f.rename(f.with_name(f"k{k}-{f.name}"))


def run(stream, path, mode="append"):
    name = f"out{next(_names)}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return stream.sparkSession.table(name)


def test_lines(spark, tmp_path):
    data = b"one\n\ntwo and more\nthree\nrest"
    chunks = [("s", k, 10 + k, data[i : i + 5]) for k, i in enumerate(range(0, len(data), 5))]
    schema = "source string, chunk_seq long, timestamp_ns long, payload binary"
    files(spark, tmp_path, [chunks[:2], chunks[2:3], chunks[3:]], schema)
    stream = stream_chunks(spark, {"format": "parquet", "path": str(tmp_path / "in"), "maxFilesPerTrigger": 1})
    got = run(stateful.split_lines_stream(stream), tmp_path)
    want = lines.split_lines(spark.createDataFrame(chunks, schema))
    key = lambda df: sorted((r["source"], r["line_no"], r["timestamp_ns"], bytes(r["raw"])) for r in df.collect())
    assert key(got) == key(want)
    assert got.count() == 3


def test_reorder_keeps_late_rows(spark, tmp_path):
    rows = [[("d", t * 1_000_000_000, "m", 20, str(t), False) for t in b] for b in ([1, 2], [100, 101], [150], [4, 151], [152])]
    rows.append([("d", 0, "", 0, "", True)])
    got = run(stateful.reorder_stream(files(spark, tmp_path, rows, LOGS), 1000), tmp_path)
    out = [(int(r["message"]), r["is_late"]) for r in got.collect()]
    assert out == [(1, False), (2, False), (100, False), (101, False), (4, True), (150, False), (151, False), (152, False)]  # in the order let go


def test_latest_and_throughput(spark, tmp_path):
    schema = "seq long, timestamp_ns long, device string, module string, level int, message string"
    rows = [(k, k * 300_000_000, "d", f"m{k % 3}", 20, str(k)) for k in range(30)]
    stream = files(spark, tmp_path, [rows[:10], rows[10:20], rows[20:]], schema)
    got = {r["module"]: r["message"] for r in run(latest.latest_by_module(stream), tmp_path, "complete").collect()}
    assert got == {"m0": "27", "m1": "28", "m2": "29"}
    frame = spark.createDataFrame(rows, schema)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(run(latest.throughput(stream), tmp_path, "complete")) == key(latest.throughput(frame))


def test_overload(spark, tmp_path):
    schema = "viewer string, timestamp_ns long"
    per = [5, 20, 20, 20, 20, 20, 3, 20, 60, 2]
    rows = [[("v", s * 1_000_000_000 + k) for k in range(n)] for s, n in enumerate(per)]
    got = sorted(tuple(r) for r in run(stateful.overload_stream(files(spark, tmp_path, rows, schema), "viewer", 10, 3, 50), tmp_path).collect())
    assert got == [("v", 1, 4, 20), ("v", 7, 8, 60)]
    logs = spark.createDataFrame([x for b in rows for x in b], schema)
    batch = latest.overload_periods(logs, 10, 3, 50).orderBy("start_s")
    assert [(r["start_s"], r["end_s"], r["peak"]) for r in batch.collect()] == [(1, 5, 20), (7, 8, 60)]


def test_fan_out(spark):
    seen = []

    def bad(batch, n):
        raise ValueError("no")

    with pytest.raises(RuntimeError, match="bad: no"):
        fan_out({"bad": bad, "good": lambda b, n: seen.append(b.count())})(spark.range(3), 0)
    assert seen == [3]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        stream_chunks(spark, {"format": "none"})


def test_seq_goes_on_over_batches_and_repeated_batches(spark, tmp_path):
    sink = order.seq_sink(str(tmp_path / "s"), ("timestamp_ns", "k"))
    rows = lambda a, b: spark.createDataFrame([(t // 2, t) for t in range(a, b)], "timestamp_ns long, k long")
    for batch_id, batch in ((0, rows(0, 50)), (1, rows(50, 50)), (2, rows(50, 80)), (2, rows(50, 80)), (3, rows(80, 100)), (1, rows(50, 50))):
        sink(batch, batch_id)
    got = {r["k"]: r["seq"] for r in spark.read.parquet(str(tmp_path / "s" / "rows")).collect()}
    assert got == {k: k + 1 for k in range(100)}


def test_key_values_of_a_stream(spark, tmp_path):
    schema = "device string, timestamp_ns long, module string, level int, message string"
    rows = [("d", k, "m", 20, f"a={k}, b=x{k}; c") for k in range(10)]
    stream = files(spark, tmp_path, [rows[:5], rows[5:]], schema)
    key = lambda df: sorted((r["timestamp_ns"], r["kv_pos"], r["module"], r["message"]) for r in df.collect())
    assert key(run(lines.extract_key_values(stream, "kv"), tmp_path)) == key(lines.extract_key_values(spark.createDataFrame(rows, schema), "kv"))


def test_a_pipeline_drops_what_a_stage_leaves_empty(spark):
    chunks = spark.createDataFrame([("s", 0, 1, b"\x01\x02\n  \nok\n\x1b[0m\n"), (None, 0, 2, b"null source\n")], "source string, chunk_seq long, timestamp_ns long, payload binary")
    spec = {"type": "serial_default", "device": "d", "parse": None}
    got = lambda **more: sorted(r["message"] for r in pipeline.build_pipeline(spec | more)(chunks).collect())
    assert got() == ["  ", "null source", "ok"]
    assert got(steps=[{"step": "fixed_width"}]) == sorted([" ", "null_source: ", "ok: ", "\x1b[0m: "])
    assert got(steps=[{"step": "strip"}]) == sorted(["null source", "ok", "\x1b[0m"])


def test_topology_orders_by_place(spark):
    chunks = spark.createDataFrame([("b", 0, 5, b"z=1\na=2\n"), ("a", 0, 5, b"m=3\n")], "source string, chunk_seq long, timestamp_ns long, payload binary")
    spec = {"main": {"type": "default", "device": "d", "sources": ["in"]}, "values": {"type": "key_value", "device": "kv", "sources": ["main"]}}
    rows = pipeline.run_topology(spec, {"in": chunks}).orderBy("seq").collect()
    assert [(r["seq"], r["source"], r["device"], r["message"]) for r in rows] == [(1, "a", "d", "m=3"), (2, "a", "kv", "3"), (3, "b", "d", "z=1"), (4, "b", "kv", "1"), (5, "b", "d", "a=2"), (6, "b", "kv", "2")]
