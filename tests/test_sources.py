"""Round trips of files."""

import os
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomlog import model, storage
from loomlog.sources import capture, session_log


def v1(ns, payload, kind=1, sync=0xA5):
    return struct.pack("<BBBBIQ", sync, kind, 1, 0, len(payload), ns) + payload


def test_raw_capture(spark, tmp_path):
    (tmp_path / "a.0000.bin").write_bytes(v1(5, b"one") + v1(6, b"", 2) + v1(7, b"x", 1, 0x00) + v1(8, b"lost"))
    (tmp_path / "a.0001.bin").write_bytes(v1(9, b"two") + v1(10, b"cut off")[:-3])
    (tmp_path / "b.0000.bin").write_bytes(v1(11, b"three") + b"\xa5\x01")
    (tmp_path / "c.0000.bin").write_bytes(b"")
    rows = capture.read_raw_capture(spark, str(tmp_path)).orderBy("source", "part", "chunk_seq").collect()
    got = [(r["source"], r["part"], r["timestamp_ns"], r["kind"], bytes(r["payload"]) if r["payload"] is not None else None, r["bad_offset"]) for r in rows]
    assert got == [
        ("a", 0, 5, 1, b"one", None), ("a", 0, 6, 2, b"", None), ("a", 0, None, None, None, 35), ("a", 1, 9, 1, b"two", None), ("a", 1, None, None, None, 19),
        ("b", 0, 11, 1, b"three", None), ("b", 0, None, None, None, 21),
    ]


def test_raw_capture_v0(spark, tmp_path):
    (tmp_path / "a.0000.bin").write_bytes(struct.pack("<QH", 3, 2) + b"hi" + struct.pack("<QH", 4, 0))
    rows = capture.read_raw_capture(spark, str(tmp_path), "v0").orderBy("chunk_seq").collect()
    assert [(r["timestamp_ns"], bytes(r["payload"])) for r in rows] == [(3, b"hi"), (4, b"")]


def test_byte_file(spark, tmp_path):
    (tmp_path / "x.dat").write_bytes(b"abcdefghij")
    rows = capture.read_byte_file(spark, str(tmp_path / "x.dat"), 4, 100, 1000, 2).orderBy("chunk_seq").collect()
    assert [bytes(r["payload"]) for r in rows] == [b"abcd", b"efgh", b"ij"] * 2
    assert [r["timestamp_ns"] for r in rows] == [1000 + k * 10_000_000 for k in range(6)]


def test_capture_table(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, 1, b"x"), ("a", 1, 2, b""), ("b", 0, 3, b"\xff\n")], model.CHUNKS)
    capture.write_raw_capture(chunks, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    key = lambda df: sorted((r["source"], r["chunk_seq"], r["timestamp_ns"], bytes(r["payload"])) for r in df.collect())
    assert key(back) == key(chunks)


def test_session_log(spark, tmp_path):
    rows = [(1, 1_700_000_000_000_001_000, "d", "a.b", 30, "x: y  z"), (2, 1_700_000_000_000_002_000, "e", "", 50, "")]
    logs = spark.createDataFrame(rows, "seq long, timestamp_ns long, device string, module string, level int, message string")
    session_log.write_session_log(logs, str(tmp_path / "s"))
    back = session_log.read_log_text(spark, str(tmp_path / "s")).orderBy("timestamp_ns")
    assert [tuple(r)[:5] for r in back.collect()] == [r[1:] for r in rows]
    bad = session_log.parse_session_lines(spark.createDataFrame([("nonsense",)], "line string")).first()
    assert bad["_error"] == "nonsense"
    assert "2023-11-14T22:13:20.000001Z W d a.b: x: y  z" in [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()]


def test_levels(spark):
    assert model.levels(spark).where(F.col("bold")).count() == 5
    assert model.level_number("WARNING") == 30


def test_stamps_do_not_drift(spark):
    files = spark.createDataFrame([("f", b"x" * 100_000), ("none", b""), ("null", None)], "source string, content binary")
    for rate, start in ((48_000, 7), (3, 0), (0.5, 0), (29.97, 1)):
        got = {r["chunk_seq"]: r["timestamp_ns"] for r in capture.cut_bytes(files, 1, rate, start).collect()}
        exact = Fraction(rate).limit_denominator(1_000_000)
        assert got == {i: start + int(i * 1_000_000_000 / exact) for i in range(100_000)}


def test_parts_of_very_many_records(spark):
    content = v1(5, b"12345678") * 50_000 + b"\xa5"
    parts = spark.createDataFrame([("a", 0, content), ("b", 0, None)], "source string, part int, content binary")
    out = capture.parse_captures(parts).groupBy("kind").agg(F.count("*").alias("n"), F.max("chunk_seq").alias("last"), F.max("bad_offset").alias("bad")).collect()
    assert sorted((tuple(r) for r in out), key=str) == [(1, 50_000, 49_999, None), (None, 1, 50_000, len(content) - 1)]


def test_session_files_roll_by_bytes(spark, tmp_path):
    rows = [(k, 1_700_000_000_000_000_000 + k * 1000, "d", "m", 20, "x" * 100) for k in range(2000)]
    logs = spark.createDataFrame(rows, "seq long, timestamp_ns long, device string, module string, level int, message string")
    session_log.write_session_log(logs, str(tmp_path / "s"), 50_000)
    files = sorted((tmp_path / "s").glob("*.txt"))
    assert 3 < len(files) < 12 and all(f.stat().st_size < 100_000 for f in files)
    assert session_log.read_log_text(spark, str(tmp_path / "s")).count() == 2000
    sink = session_log.session_log_sink(str(tmp_path / "b"))
    for batch, part in ((0, logs.where("seq < 500")), (0, logs.where("seq < 1000")), (1, logs.where("seq >= 1000"))):
        sink(part, batch)
    assert session_log.read_log_text(spark, str(tmp_path / "b")).count() == 2000
    assert session_log.read_log_text(spark, str(tmp_path / "b" / "batch=0")).count() == 1000


def test_capture_sink(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, 1, b"x"), ("a", 1, 2, b"")], model.CHUNKS)
    sink = capture.raw_capture_sink(str(tmp_path / "c"))
    for batch in (0, 0, 1):
        sink(chunks, batch)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4


def test_shared_folder_and_passing_tables(spark, tmp_path):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        storage.shared_dir(Cluster)
    with storage.passing() as keep:
        gone, kept = storage.materialize(spark.range(3), "gone"), keep(storage.materialize(spark.range(4), "kept"))
        assert gone.count() == 3
    assert kept.count() == 4 and not os.path.exists(gone.inputFiles()[0].removeprefix("file:") if gone.__dict__.get("_scratch_path") else "")
    storage.drop(kept, spark.range(2))
    assert "_scratch_path" not in kept.__dict__
