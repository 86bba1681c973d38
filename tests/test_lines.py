import random

import pytest
from pyspark.sql import functions as F

from loomlog.operators import filters, latest, lines, modules, order, signals
from loomlog.operators.signals import SIGNALS

RAW = b"one\n\ntwo\r\n" + bytes(range(128, 200)) + b"\nthree\nrest"


def chunked(data, size):
    return [("s", k, 1000 + k, data[i : i + size]) for k, i in enumerate(range(0, len(data), size))]


@pytest.mark.parametrize("size", [1, 7, 10_000])
@pytest.mark.parametrize("block", [2, 10_000])
def test_lines_do_not_depend_on_the_cuts(spark, size, block):
    chunks = spark.createDataFrame(chunked(RAW, size), "source string, chunk_seq long, timestamp_ns long, payload binary")
    rows = lines.split_lines(chunks, block=block).orderBy("line_no").collect()
    assert [bytes(r["raw"]) for r in rows] == [x for x in RAW.split(b"\n")[:-1] if x]
    at, want = 0, []
    for part in RAW.split(b"\n")[:-1]:
        at += len(part) + 1
        if part:
            want.append(1000 + (at - 1) // size)
    assert [r["timestamp_ns"] for r in rows] == want


def test_parse_line_errors(spark):
    rows = spark.createDataFrame([(5, "a b  "), (6, "I app.x: hello   world "), (7, "Q app.x: hi"), (8, ""), (9, None), (10, "W bad-name: hi")], "timestamp_ns long, line string")
    out = lines.route_errors(lines.parse_line(rows, "D", level_index=0, module_index=1, message_index=2)).orderBy("timestamp_ns").collect()
    got = [(r["level"], r["module"], r["message"]) for r in out]
    bad = lambda text: (40, "_unknown", text)
    assert got == [bad("a b  "), (20, "app.x", "hello   world "), bad("Q app.x: hi"), bad(""), bad(""), bad("W bad-name: hi")]
    assert lines.route_errors(lines.parse_line(rows, "D", level_index=0, module_index=1, message_index=2), True).count() == 1


def test_key_values(spark):
    logs = spark.createDataFrame([(1, "d", "m", 20, "a=1, =2 b= c=d=e; X=9"), (2, "system", "m", 20, "a=1"), (3, "kv", "m", 20, "a=1"), (4, "d", "m", 20, "b c=")], "timestamp_ns long, device string, module string, level int, message string")
    got = [(r["module"], r["message"]) for r in lines.extract_key_values(logs, "kv").orderBy("kv_pos").collect()]
    assert got == [("m.a", "1"), ("m.c", "d=e"), ("m.x", "9")]


def test_seq_equals_a_global_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "timestamp_ns long, k long").repartition(5)
    for n in (1, 3, 16):
        got = {r["k"]: r["seq"] for r in order.assign_seq(frame, ("timestamp_ns", "k"), n).collect()}
        assert got == {k: i + 1 for i, (_, k) in enumerate(sorted(rows))}


def test_signals(spark):
    def big(bits, start, length):
        pos, out = start, 0
        for _ in range(length):
            out = out << 1 | (bits[pos // 8] >> (pos % 8) & 1)
            pos = pos - 1 if pos % 8 else pos + 15
        return out

    def little(bits, start, length):
        return int.from_bytes(bits, "little") >> start & (1 << length) - 1

    rng = random.Random(4)
    frames = [(k, k, 1, 8, bytes(rng.randrange(256) for _ in range(8))) for k in range(20)]
    cases = [(rng.randrange(8), rng.randint(1, 20)) for _ in range(12)]
    entries, want = [], []
    for n, (start, length) in enumerate(cases):
        entries.append((1, "m", f"l{n}", start, length, True, False, 1.0, 0.0, None, None))
        entries.append((1, "m", f"b{n}", start + 7, length, False, True, 1.0, 0.0, None, None))
    for k, _, _, _, data in frames:
        for n, (start, length) in enumerate(cases):
            want.append((k, f"l{n}", float(little(data, start, length))))
            v = big(data, start + 7, length)
            want.append((k, f"b{n}", float(v - (1 << length) if v >> (length - 1) else v)))
    f = spark.createDataFrame(frames, "frame_seq long, timestamp_ns long, arbitration_id int, dlc int, data binary")
    d = spark.createDataFrame(entries, SIGNALS)
    got = [(r["frame_seq"], r["signal"], r["value"]) for r in signals.decode_signals(f, d).collect()]
    assert sorted(got) == sorted(want)


def test_unmapped_short_and_muxed_frames(spark):
    f = spark.createDataFrame([(1, 1, 26, 2, b"\x01\x02"), (2, 2, 7, 1, b"\x01"), (3, 3, 7, 2, b"\x01\x05"), (4, 4, 7, 2, b"\x02\x05")], "frame_seq long, timestamp_ns long, arbitration_id int, dlc int, data binary")
    d = spark.createDataFrame([(7, "m", "mux", 0, 8, True, False, 1.0, 0.0, None, None), (7, "m", "a", 8, 8, True, False, 0.5, 1.0, None, 1), (7, "m", "b", 8, 8, True, False, 1.0, 0.0, None, 2)], SIGNALS)
    got = sorted((r["frame_seq"], r["signal"], r["text"]) for r in signals.decode_signals(f, d).collect())
    assert got == [(1, "unmapped", "001A | 2 | 0102"), (2, "error", "0007 | 1 | 01 | Decoding error: payload too short"), (2, "mux", "1"), (3, "a", "3.500"), (3, "mux", "1"), (4, "b", "5"), (4, "mux", "2")]
    assert signals.decode_signals(f, d, "ignore").where("frame_seq = 1").count() == 0
    strict = signals.error_rows(signals.decode_signals(f, d, "strict"), "can").collect()
    assert [r["message"] for r in strict] == ["001A | 2 | 0102"]


def test_levels_come_from_the_nearest_listed_ancestor(spark):
    known = spark.createDataFrame([("d", m) for m in ("", "a", "a.b", "a.b.c", "x")], "device string, module string")
    over = spark.createDataFrame([("d", "a", False, 0), ("d", "a.b", True, 30)], "device string, module string, enabled boolean, level int")
    got = {r["module"]: r["min_level"] for r in filters.effective_levels(known, over, "INFO").collect()}
    assert got == {"": 20, "a": 100, "a.b": 30, "a.b.c": 30, "x": 20}


def test_modules_of_an_empty_log(spark):
    logs = spark.createDataFrame([], "seq long, device string, module string")
    assert modules.modules(logs).count() == 0
    assert modules.devices(logs).count() == 0
    assert filters.find_text(logs.select(F.lit("x").alias("line")), " ").count() == 0


CHUNK = "source string, chunk_seq long, timestamp_ns long, payload binary"


def test_null_sources_and_tails_without_end(spark):
    rows = [(None, 0, 1, b"a\nb"), (None, 1, 2, b"c\n"), ("s", 0, 3, b"x\n\ny\nz")] + [("tail", k, k, b"never ends ") for k in range(3000)]
    out = lines.split_lines(spark.createDataFrame(rows, CHUNK), block=100).collect()
    got = sorted(((r["source"], r["line_no"], r["timestamp_ns"], bytes(r["raw"])) for r in out), key=str)
    assert got == sorted([(None, 0, 1, b"a"), (None, 1, 2, b"bc"), ("s", 0, 3, b"x"), ("s", 2, 3, b"y")], key=str)
    zero = spark.createDataFrame([("s", 0, 1, b"a\x00b\x00")], CHUNK)
    assert [bytes(r["raw"]) for r in lines.split_lines(zero, sep=0).orderBy("line_no").collect()] == [b"a", b"b"]
    assert lines.split_lines(zero.limit(0)).count() == 0


def test_words_are_parted_by_unicode_space(spark):
    rows = spark.createDataFrame([(1, "I\u00a0app.x\u2003hello  there")], "timestamp_ns long, line string")
    out = lines.parse_line(rows, "D", level_index=0, module_index=1, message_index=2).first()
    assert (out["level"], out["module"], out["message"], out["_error"]) == (20, "app.x", "hello  there", None)


def test_a_filter_on_parsed_rows_does_not_parse_twice(spark):
    rows = spark.createDataFrame([(1, "[1.5] I app.x: hi")], "timestamp_ns long, line string")
    out = lines.parse_line(rows, "D", time_index=0, level_index=1, module_index=2, message_index=3).where("_error is null and level >= 20")
    assert out.count() == 1
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_multiplexers_have_any_name_and_frames_any_columns(spark):
    frames = spark.createDataFrame([(7, 1, 4, b"\x01\x05\x06\x02"), (7, 2, 4, b"\x02\x05\x06\x02"), (7, 3, 1, b"\x01")], "arbitration_id int, timestamp_ns long, dlc int, data binary")
    entries = [("page", 0, None, None), ("a", 8, 1, "page"), ("b", 16, 2, "page"), ("kind", 24, None, None), ("c", 8, 2, "kind"), ("d", 8, 3, "kind")]
    known = spark.createDataFrame([(7, "m", name, start, 8, True, False, 1.0, 0.0, None, value, switch) for name, start, value, switch in entries], f"{SIGNALS}, mux_signal string")
    got = sorted((r["timestamp_ns"], r["signal"], r["text"]) for r in signals.decode_signals(frames, known).where("signal <> 'error'").collect())
    assert got == [(1, "a", "5"), (1, "c", "5"), (1, "kind", "2"), (1, "page", "1"), (2, "b", "6"), (2, "c", "5"), (2, "kind", "2"), (2, "page", "2"), (3, "page", "1")]


def test_module_levels_with_a_table_of_modules(spark):
    logs = spark.createDataFrame([("d", "a.b", 20), ("d", "x", 20), ("d", "a.c", 40)], "device string, module string, level int")
    over = spark.createDataFrame([("d", "a", True, 30)], "device string, module string, enabled boolean, level int")
    known = logs.select("device", "module").distinct()
    want = [("a.c", 40), ("x", 20)]
    for one in (None, known):
        assert sorted((r["module"], r["level"]) for r in filters.filter_module_levels(logs, over, "INFO", one).collect()) == want


def test_changes_do_not_depend_on_blocks(spark):
    rng = random.Random(2)
    rows = [(k, kv, "d", f"m{rng.randrange(3)}", rng.choice(["x", "y", None])) for k in range(400) for kv in range(2)]
    logs = spark.createDataFrame(rows, "seq long, kv_pos int, device string, module string, message string")
    last, want = {}, []
    for seq, kv, _, module, message in rows:
        if last.get(module) is None or last[module] != message:
            want.append((seq, kv))
        last[module] = message
    for block in (1, 7, 100, 1_000_000):
        assert sorted((r["seq"], r["kv_pos"]) for r in latest.value_changes(logs, block).collect()) == want


def test_overload_over_midnight(spark):
    day = 86_400
    busy = [*range(day - 2, day + 2), *range(2 * day - 1, 3 * day + 1), 5 * day, 7 * day - 1, 9 * day, 100, 101, 102, 103]
    logs = spark.createDataFrame([(s,) for s in busy], "s long").selectExpr("s * 1000000000 as timestamp_ns", "explode(sequence(1, 2)) as k")
    got = sorted((r["start_s"], r["end_s"], r["rows"]) for r in latest.overload_periods(logs, 1, 3, 50).collect())
    assert got == [(100, 103, 8), (day - 2, day + 1, 8), (2 * day - 1, 3 * day, 2 * (day + 2))]
    assert latest.overload_periods(logs.limit(0)).count() == 0
