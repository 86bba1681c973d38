"""Secrets, toxicity, licences and token counts."""

import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlog.llm import licenses, logistic, queries, secret_scan, token_counts, toxicity
from loomlog.llm.base import scratch
from loomlog.llm.tokenizer import tokenizer

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def brute_secrets(rows, most_owners=2, most_repositories=4):
    """rows: (doc_id, text, source, lang)"""
    found, owners, repositories = [], {}, {}
    for doc_id, text, source, lang in rows:
        own = base(text)
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9_+/-]{20,}", text or "") if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])]
        more = [x for x in more if not any(b[0] < x[2] and b[2] > x[0] for b in own)]
        found.append((doc_id, own, more))
        for x in own + more:
            owners.setdefault(x[3], set()).add(source or "")
            repositories.setdefault(x[3], set()).add((source or "", lang or ""))
    out = []
    text_of = lambda spans: ",".join(f"{('assign', 'access', 'hex', 'owned')[k]}:{s}:{e}" for s, k, e, _ in sorted(spans))
    for doc_id, own, more in found:
        live = [x for x in more if len(owners[x[3]]) <= most_owners and len(repositories[x[3]]) <= most_repositories]
        n = [sum(x[1] == k for x in own) for k in range(3)]
        out.append((doc_id, *n, hashlib.sha256(text_of(own).encode()).hexdigest(), text_of(own + live)))
    return sorted(out, key=str)


def secrets_of(df, id_of=lambda r: r["doc_id"]):
    return sorted(((id_of(r), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in df.collect()), key=str)


LIVE = "Zx9" + "aQ7b" * 6
SPREAD = "Ww7" + "cS5d" * 6
COPIED = "Yy8" + "bR6c" * 6
ROWS = [
    *[(20 + k, f"see {SPREAD}", "a") for k in range(5)], (None, None, "a"), (1, "", None), (2, "token=ab secret:abcdef", "a"), (3, "token=token:abcdefg PASSWORD = 'hunter22'", "a"), (4, "é日 api_key=\"" + "x" * 40, "a"),
    (5, "AKIA" + "Z" * 16 + " AKIASHORT " + "AKIA" * 6, "b"), (6, "f" * 24 + " " + "e" * 23 + " token=" + "0a" * 20, "b"), (7, f"key {LIVE}.", "a"), (7, f"key {LIVE}.", "a"),
    (8, f"see {COPIED}", "a"), (9, f"see {COPIED}", "b"), (10, f"see {COPIED}", "c"), (11, "ſecret=abcdef toKen=abcdefg passwd:=zzzzzzz", "c"), (12, "secret=" + LIVE + " token=x" * 700, "d"), (13, "pw " * 5 + "a" * 30, None),
]


def test_secrets_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    want = brute_secrets([(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()])
    assert any(r[1] + r[2] + r[3] for r in want)
    assert secrets_of(queries.op5_secret_scan(spark, SF2)) == want
    rows = [(*r, f"l{r[0]}" if SPREAD in (r[1] or "") else "en") for r in ROWS]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, source string, lang string, n_hex int, spans string")
    want = brute_secrets(rows)
    assert {r[0]: "owned" in r[-1] for r in want if r[0] in (7, 20)} == {7: True, 20: False}  # one owner each, but five repositories
    assert secrets_of(secret_scan.scan(frame), lambda r: r["_row"]["doc_id"]) == want
    assert secret_scan.scan(frame.limit(0)).count() == 0


def test_redaction_equals_the_spans_reported(spark):
    rng = random.Random(8)
    parts = ["token=", "api_key: ", "AKIA" + "Q" * 16, "0a" * 14, "é", " ", "secret = '", LIVE, "x", ".", "hunter22", "日\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)] + ["token=abcdef1 " * 3000, None, ""]
    frame = spark.createDataFrame([(k, t, "s", "en", -1, "e") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long, `a.b` string")
    spans = {r["_row"]["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x] for r in secret_scan.scan(frame).collect()}
    out = secret_scan.redact(frame)
    assert out.columns == frame.columns
    for r in out.collect():
        text, marked = texts[r["doc_id"]], set()
        for a, b in spans[r["doc_id"]]:
            marked.update(range(a, b))
        if not marked:
            assert (r["text"], r["n_chars"]) == (text, -1)
            continue
        starts = {a for a, _ in spans[r["doc_id"]] if a - 1 not in marked or not any(x < a < y for x, y in spans[r["doc_id"]])}
        want = "".join("[SECRET]" if k in starts else "" if k in marked else c for k, c in enumerate(text))
        assert r["text"] == want and r["n_chars"] == len(want)


def test_redaction(spark):
    frame = spark.createDataFrame([(*r, "en", 7) for r in ROWS], "doc_id long, text string, source string, lang string, n_chars long")
    out = {r["doc_id"]: r for r in secret_scan.redact(frame).collect()}
    assert list(out[7].asDict()) == frame.columns
    assert out[7]["text"] == "key [SECRET]." and out[7]["n_chars"] == len("key [SECRET].")
    assert out[8]["text"] == f"see {COPIED}" and out[8]["n_chars"] == 7
    assert out[3]["text"] == "token=token:abcdefg [SECRET]'"
    assert out[5]["text"] == "[SECRET] AKIASHORT [SECRET]"
    assert all(not base(r["text"]) for r in out.values())


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    out = queries.op6_toxicity(spark, SF2).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] != r["toxic"] for r in out) <= 0.1 * len(out)
    assert any(r["predicted"] and r["toxic"] for r in out)


def test_toxicity_does_not_learn_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda x: sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(docs, x).collect())
    assert key(labels) == key(flipped)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "clown": 2.0, "trash": 1.0})
    hits = lambda text: lexicon.figures(text)[0]
    assert hits("an 1d10t") == hits("an idiot") == hits("AN IDI0T!") == hits("an іdіоt") > 0
    assert hits("c1own") == hits("clown") > 0
    assert hits("xidiot") == hits("the trash can is full") == hits(None) == hits("") == 0
    assert hits("trash talk") > 0


def test_punctuation_and_spacing_hide_nothing():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "trash": 1.0})
    assert lexicon.figures("you idiot" + "!" * 1000) == lexicon.figures("you  \n idiot") == lexicon.figures("you idiot")
    assert lexicon.figures("the trash\n\tcan, is full")[0] == 0
    assert toxicity.fold("Ｉｄｉｏｔ") == toxicity.fold("ídïöt") == toxicity.fold("id\u200biot") == " idiot "
    assert toxicity.fold(None) == toxicity.fold(" ... ") == " "


TERMS = {"idiot": 3.0, "idio": 1.0, "clown": 2.0, "trash": 1.0, "luser": 0.5}
TEXT_PARTS = [*"  .!\n@$1", "idiot", "idiotic", "idio", "clown", "trash", "can", "trash can", "class clown", "1user", "x", "ID10T", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TEXT_PARTS), max_size=25).map("".join))
def test_figures_equal_a_plain_restatement(text):
    words = toxicity.fold(text).split()
    safe = {k + j for phrase in map(str.split, toxicity.EXCEPTIONS) for k in range(len(words)) if words[k : k + len(phrase)] == phrase for j in range(len(phrase))}
    forms = {f: w for t, w in TERMS.items() for f in (t.replace("l", "i"), t)} | TERMS
    found = []
    for k, word in enumerate(words):
        own = [f for f in forms if word.startswith(f)]
        if own and k not in safe:
            found.append(forms[max(own, key=len)])
    n = max(1, len(words))
    want = (math.log1p(sum(found)), math.log1p(100 * sum(found) / n), float(len(found) > 0), float(len(found) > 1), math.log1p(n))
    assert toxicity.Lexicon(TERMS).figures(text) == pytest.approx(want)


def test_lexicon_equals_counts_of_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    rows = [(r["text"], known[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in known]
    seen, n = {}, [0, 0]
    for text, y in rows:
        n[y] += 1
        words = toxicity.fold(text).split()
        for term in {w[:k] for w in words for k in (*range(4, 10), len(w))}:
            if len(term) >= 4 or term in words:
                seen.setdefault(term, [0, 0])[y] += 1
    weights = {t: math.log(((p + 0.5) / (n[1] + 1)) / ((c + 0.5) / (n[0] + 1))) for t, (c, p) in seen.items() if p >= 5}
    sample = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 20_000, ~toxicity.held_out("doc_id"))
    assert sample.count() == len(rows)
    assert toxicity.learn(sample)[0].terms == pytest.approx({t: w for t, w in weights.items() if w >= 1.5})


def test_toxicity_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(k % 5, f"text {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 3, F.lit(True))
    assert sample.count() == 3 and sorted(map(tuple, sample.collect())) == sorted(map(tuple, sample.collect()))


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 3), (2, "a b", 4), (3, "word " * 50_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    clean = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    want = con.sql(oracles_of(name)).select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert clean(tuple(r) for r in df.select(*columns).collect()) == clean(want)


def oracles_of(name):
    return queries.oracle_sql()[name]


def test_licenses_edge_cases(spark):
    apache = licenses.TEMPLATES["apache-2.0"][0]
    texts = [None, "", "x", apache, f"intro\n\n{apache.upper()}\nend", "Licensed under the Apache License", apache + " now ok", "\n".join(["w " * 50_000, licenses.TEMPLATES["mit"][0]])]
    frame = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)] + [(None, apache, "n"), (3, apache, "n")], "doc_id long, text string, license string")
    got = sorted(((r["doc_id"], r["license"], r["unit"], round(r["dice"], 3)) for r in licenses.scan(frame).collect()), key=str)
    apaches = [(3, 0, 1.0), (4, 3, 1.0), (5, 0, 0.8), (6, 0, 0.857), (None, 0, 1.0)]
    assert got == sorted([*[(d, "apache-2.0", unit, dice) for d, unit, dice in apaches], (7, "mit", 2, 1.0)], key=str)
    assert licenses.scan(frame.limit(0)).count() == 0


def test_rollup_is_idempotent_and_additive(spark):
    docs = spark.createDataFrame([("a", "en", "x y z"), ("a", None, None), (None, "en", "it's"), ("a", "en", "x y z")], "source string, lang string, text string")
    rollup = token_counts.TokenRollup(spark, scratch(spark, "t"))
    assert rollup.totals().count() == 0
    totals = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    assert rollup.commit("one", token_counts.inserts(docs, "words-1"))
    assert not rollup.commit("one", token_counts.inserts(docs, "words-1"))
    want = {("a", "en", "words-1"): (2, 6), ("a", None, "words-1"): (1, 0), (None, "en", "words-1"): (1, 1)}
    assert totals() == want
    rollup.compact()
    assert totals() == want and not rollup.commit("one", token_counts.inserts(docs, "words-1"))
    assert rollup.commit("fix", token_counts.revisions(docs.where("text = 'x y z'"), "words-1", old_text=F.col("text"), new_text=F.lit("one")))
    assert rollup.commit("gone", token_counts.deletes(docs.where("source is null"), "words-1"))
    assert rollup.commit("none", token_counts.inserts(docs.limit(0), "words-1"))
    assert rollup.commit("bpe", token_counts.inserts(docs, "byte_bpe_50k"))
    rollup.compact()
    assert not rollup.commit("gone", token_counts.inserts(docs, "words-1"))
    assert totals() == {("a", "en", "words-1"): (2, 2), ("a", None, "words-1"): (1, 0), ("a", "en", "byte_bpe_50k"): (2, 6), ("a", None, "byte_bpe_50k"): (1, 0), (None, "en", "byte_bpe_50k"): (1, 2)}
    with pytest.raises(ValueError):
        rollup.commit("a/b", docs)


@pytest.mark.parametrize("when", ["before the fold", "after the fold"])
def test_a_batch_committed_while_compacting_is_kept_once(spark, monkeypatch, when):
    docs = spark.createDataFrame([("a", "en", "x y")], "source string, lang string, text string")
    rollup = token_counts.TokenRollup(spark, scratch(spark, "race"))
    rollup.commit("one", token_counts.inserts(docs, "words-1"))
    plain, done = rollup._rows, []

    def with_a_commit(base, batches):
        if when == "before the fold" and not done:
            done.append(rollup.commit("two", token_counts.inserts(docs, "words-1")))
        rows = plain(base, batches)
        if when == "after the fold" and not done:
            rows.count()
            done.append(rollup.commit("two", token_counts.inserts(docs, "words-1")))
        return rows

    monkeypatch.setattr(rollup, "_rows", with_a_commit)
    rollup.compact()
    monkeypatch.undo()
    assert done == [True]
    for _ in range(3):
        assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "words-1", 2, 4)]
        assert not any(rollup.commit(x, token_counts.inserts(docs, "words-1")) for x in ("one", "two"))
        rollup.compact()


def test_a_reader_outlives_one_compaction(spark):
    docs = spark.createDataFrame([("a", "en", "x y")], "source string, lang string, text string")
    rollup = token_counts.TokenRollup(spark, scratch(spark, "reader"))
    for name in ("one", "two", "three"):
        rollup.commit(name, token_counts.inserts(docs, "words-1"))
        before = rollup.totals()
        rollup.compact()
        assert [tuple(r) for r in before.collect()] == [tuple(r) for r in rollup.totals().collect()]
    rollup.commit("four", token_counts.deletes(docs, "words-1"))
    rollup.compact()
    assert set(rollup.batches()) == {"four"} and rollup._bases() == [2, 3]


def test_token_count_edge_cases(spark):
    rows = [("a", "en", "word " * 200_000, 5, "o"), ("a", "en", "word " * 200_000, 5, "o"), (None, None, None, 0, None), ("a", "en", "", 0, None)]
    docs = spark.createDataFrame(rows, "source string, lang string, text string, n_tokens int, tokenizer_version string")
    got = {tuple(r) for r in token_counts.inserts(docs, "words-1", "byte_bpe_50k").collect()}
    assert got == {("a", "en", "words-1", 3, 400_000), (None, None, "words-1", 1, 0), ("a", "en", "byte_bpe_50k", 3, 400_002), (None, None, "byte_bpe_50k", 1, 0)}


def test_whole_token_counts_equal_brute_force(spark):
    count = {
        "words-1": lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)),
        "marks-1": lambda t: len(re.findall(r"[A-Za-z0-9\x80-\U0010FFFF]+|[^A-Za-z0-9\x80-\U0010FFFF\x00-\x20]", t)),
        "byte_bpe_50k": lambda t: len(tokenizer().plain(t)),
    }
    want = {}
    for r in spark.read.parquet(f"{SF2}/documents.parquet").collect():
        for version, n in count.items():
            docs, tokens = want.get((r["source"], r["lang"], version), (0, 0))
            want[r["source"], r["lang"], version] = docs + 1, tokens + n(r["text"] or "")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in queries.op1_token_counts(spark, SF2).collect()} == want


def test_licenses_wrapped_over_lines_of_longer_texts(spark):
    wrap = lambda name, width, mark="": "\n".join(mark + x for x in textwrap.wrap(licenses.TEMPLATES[name][0], width))
    prose = " ".join(f"word{k}" for k in range(60))
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrap("mit-text", 78) + "\n\nThe above copyright notice shall be included.\n\n" + " ".join(f"word{k}" for k in range(60))
    texts = [mit, prose + "\n" + wrap("bsd", 70, " * ") + "\n" + prose, wrap("isc", 60, "# ") + "\n\n" + prose, prose + "\n" + wrap("mpl-2.0", 40) + "\n\n" + prose, prose + "\nPermission is hereby granted, free\nof charge, to nobody\nLicensed under CC BY-ND 4.0.\n" + prose]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, mit)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["license"], r["unit"], r["dice"] >= 0.95) for r in licenses.scan(frame).collect()), key=str)
    assert got == sorted([(0, "mit-text", 5, True), (1, "bsd", 2, True), (2, "isc", 1, True), (3, "mpl-2.0", 2, True), (None, "mit-text", 5, True)], key=str)


def test_whole_licences_and_their_kin(spark):
    head = "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n"
    prose = " ".join(f"word{k}" for k in range(60))
    wrap = lambda name: "\n".join(textwrap.wrap(licenses.WHOLE[name], 76))
    names = sorted(licenses.WHOLE)
    rows = [(f"{name} {kind}", text) for name in names for kind, text in (("whole", head + licenses.WHOLE[name]), ("wrapped", head + wrap(name)), ("inside", f"{prose}\n\n{wrap(name)}\n\n{prose}"))]
    found = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        found.setdefault(r["doc_id"], {})[r["license"]] = r["dice"]
    for row, _ in rows:
        name = row.split(" ")[0]
        assert found[row][name] >= 0.8, row
        assert row.endswith("inside") or found[row][name] == max(found[row].get(x, 0) for x in names), row
    assert "bsd-3-clause" not in found["isc whole"]


def test_runs_of_dots_take_linear_time(spark):
    texts = ["." * 1_000_000, "a." * 500_000, "licensed " + "." * 300_000 + " apache", "..v2..", ". . .x. ..y"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.normal_words(F.col("t")).alias("w"))
    got = [r["w"] for r in frame.collect()]
    assert got == [[], ["a." * 499_999 + "a"], ["licensed", "apache"], ["..v2"], [".x", "..y"]]
    assert licenses.scan(spark.createDataFrame([(1, texts[2])], "doc_id long, text string")).count() == 0


def test_notices_repeated_thousands_of_times(spark):
    """A text of 20,000 words, each line a notice; the notice wrapped over lines; and a whole licence wrapped over lines again and again."""
    began = time.perf_counter()
    wrapped = "\n".join(textwrap.wrap(licenses.WHOLE["mit"], 60))
    rows = [(1, "Released under the MIT License.\n" * 4000), (2, "other words\nreleased under\nthe MIT License.\n" * 3000), (3, f"{wrapped}\nand then\n" * 100)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = (r["unit"], r["dice"])
    assert got[1] == {"mit": (1, 1.0)} and got[2] == {"mit": (2, 1.0)}
    assert got[3]["mit"][0] in (0, 1) and got[3]["mit"][1] > 0.95
    assert time.perf_counter() - began < 120


def test_exceptions_are_walked_once():
    began = time.perf_counter()
    lexicon = toxicity.Lexicon({"idiot": 1.0, "trash": 2.0}, ("trash can", "can idiot proof"))
    total = lexicon.figures("trash can idiot " * 100_000)[0]
    assert total == pytest.approx(math.log1p(100_000)) and time.perf_counter() - began < 10
    assert lexicon.figures("trash can idiot proof trash")[0] == pytest.approx(math.log1p(2.0))


def test_toxicity_equals_a_plain_restatement(spark):
    """The whole query again over lists: counts of documents by term, weights, calibration, scores."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    known = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect():
        known[r["doc_id"]] = max(r["toxic"], known.get(r["doc_id"], 0))
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in docs}
    sample = [(t or "", known[d]) for d, t in docs if d in known and not held[d]]
    counts, n = {}, [sum(y == k for _, y in sample) for k in (0, 1)]
    for text, y in sample:
        for word in {w[:k] for w in toxicity.fold(text).split() for k in (len(w), *range(4, min(9, len(w)) + 1))}:
            counts.setdefault(word, [0, 0])[y] += 1
    weight = {w: math.log(((t + 0.5) / (n[1] + 1)) / ((c + 0.5) / (n[0] + 1))) for w, (c, t) in counts.items() if t >= 5}
    lexicon = toxicity.Lexicon({w: x for w, x in weight.items() if x >= 1.5})
    data = np.array([(*lexicon.figures(t), y) for t, y in sample])
    data = data[np.lexsort(data.T)]
    fitted = logistic.fit(data[:, :5], data[:, 5])
    want = logistic.score(np.array([lexicon.figures(t) for _, t in docs]), fitted)
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, SF).collect()}
    assert len(got) == len(docs) and n[1] >= 5
    for (d, _), score in zip(docs, want, strict=True):
        assert got[d]["held_out"] == held[d] and got[d]["score"] == pytest.approx(score, rel=1e-6, abs=1e-9) and got[d]["predicted"] == int(got[d]["score"] >= 0.3)
