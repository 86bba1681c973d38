"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from loomlog.functions import text as T
from loomlog.plans import pipeline


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("o")).first()["o"]


def test_bytes(spark):
    raw = bytes([0x41, 0xFF, 0x0D, 0x1B, 0x5B, 0x42, 0x1F, 0x09])
    assert bytes(one(spark, raw, T.printable, "binary")) == b"A\x1b[B"
    assert bytes(one(spark, raw, lambda c: T.printable(c, False), "binary")) == b"A[B"
    assert one(spark, b"a\xe9b", T.decode_bytes, "binary") == "a�b"
    assert one(spark, b"a\xe9b", lambda c: T.decode_bytes(c, errors="ignore"), "binary") == "ab"
    assert one(spark, b"a\xe9b", lambda c: T.decode_bytes(c, errors="strict"), "binary") is None
    assert one(spark, "aé".encode(), lambda c: T.decode_bytes(c, "utf-8", "strict"), "binary") == "aé"
    assert one(spark, b"a\xff", lambda c: T.decode_bytes(c, "utf-8", "strict"), "binary") is None
    assert one(spark, b"a\xff", lambda c: T.decode_bytes(c, "utf-8", "ignore"), "binary") == "a"


def test_text(spark):
    assert one(spark, "\x1b[31mhi", T.ansi_filter) == "hi"
    assert one(spark, " a  \t b ", T.whitespace_normalize) == "a b"
    assert one(spark, "app: [TAG1] [TAG2] Message", T.path_normalize) == "app.tag1.tag2 Message"
    assert one(spark, "I (1510) [CAN TEST]: message", lambda c: T.path_normalize(c, 2)) == "I (1510) can_test message"
    assert one(spark, "[open message", T.path_normalize) == "[open message"
    assert one(spark, "one", lambda c: T.path_normalize(c, 2)) == "one"
    assert one(spark, "3V3 / 5V".ljust(25) + "on", T.fixed_width_normalize) == "3v3_5v: on"
    assert one(spark, "x " + "3V3 / 5V".ljust(25) + "on ", lambda c: T.fixed_width_normalize(c, 1)) == "x 3v3_5v: on"
    with pytest.raises(ValueError):
        T.string_replace(F.lit("x"), "")


def test_numbers_and_durations(spark):
    want = [1, 5, 10, 1.2, 0.3, 3, -4, 0.5, -0.0025, 0, 1]
    assert one(spark, "v=1e5 10. 1.2.3 3-4 .5 -2.5e-3 0x1F", T.extract_numbers) == want
    for text, seconds in (("10s", 10), ("5m", 300), ("2h", 7200), ("1.5m", 90), ("7", 7), ("x", None), (None, None)):
        assert one(spark, text, T.parse_duration) == seconds


def test_modules(spark):
    assert one(spark, "App.X_1", T.normalize_module) == "app.x_1"
    assert one(spark, "a\n", T.normalize_module) is None
    assert one(spark, "a b", T.normalize_module) is None
    assert one(spark, "a.b.c", T.parent_path) == "a.b"
    assert one(spark, "a", T.parent_path) == ""
    assert one(spark, "", T.parent_path) is None


def test_search(spark):
    texts = ["aa", "bb", "aa cc", "dd"]
    frame = spark.createDataFrame([(t,) for t in texts], "v string")
    find = lambda q: [r["v"] for r in frame.where(T.search_condition(F.col("v"), q)).collect()]
    assert find("a+C bb -dd") == ["bb", "aa cc"]
    assert find("-aa") == ["bb", "dd"]
    assert find("") == texts
    assert find("-") == texts
    assert find("+") == texts


def test_steps_check_their_types():
    with pytest.raises(TypeError):
        pipeline.transform_steps(F.lit("x"), [{"step": "printable"}])
    with pytest.raises(ValueError):
        pipeline.transform_steps(F.lit("x"), [{"step": "none"}])
    with pytest.raises(ValueError):
        pipeline.register_step("Strip")(T.strip)
    with pytest.raises(ValueError):
        pipeline.build_pipeline({"type": "none"})


def test_headers_of_very_many_tags(spark):
    text = "[tag] " * 100_000 + "rest"
    row = spark.createDataFrame([(text,)], "t string").select(T.path_normalize(F.col("t")).alias("x")).first()
    assert row["x"] == ".".join(["tag"] * 100_000) + " rest"


def test_latin_1(spark):
    row = spark.createDataFrame([(bytes(range(256)),)], "raw binary").select(*[T.decode_bytes(F.col("raw"), e, how).alias(f"{e}{how}") for e in ("latin-1", "ISO-8859-1") for how in ("replace", "strict")]).first()
    assert set(row) == {bytes(range(256)).decode("latin-1")}
