import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


EDGES = [None, "", "a " * 5000, "a\x0bb\x0cc\td\re", "x y\n\n \nx y\nx  y", "€ ü#* " * 30, "one two three four five six seven eight nine " * 2, " ".join(str(i) for i in range(40_000)), "   a"]


def test_base_figures(spark):
    texts = EDGES + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    frame = spark.createDataFrame([(k, t, "en", 1, True) for k, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int, kept boolean")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules.judge(frame, labels).collect()
    got = {r["_row"]["doc_id"]: tuple(r[c] for c in (*quality_rules.BASE, "base_failed")) for r in rows}
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    assert all(r["kept"] != r["base_failed"] for r in rows)  # nothing is certified without labels


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 7, 300, 40_000) for k in (0, 1, 3, 250) if k <= n]
    frame = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p"))
    for r in frame.collect():
        n, k = r["n"], r["k"]
        want = 1.0 if k >= n * 0.01 else math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.01) + (n - j) * math.log(0.99)) for j in range(k + 1))
        assert r["p"] == pytest.approx(want, rel=1e-6)


def test_cutoffs_are_certified_per_stratum(spark):
    rows = []
    for k in range(3000):
        lang = ("en", "fr", None)[k % 3]
        bad = k % 10 == 0 or (lang == "fr" and k % 4 == 0)
        rows.append((k, " ".join(f"w{k}x{i}" + ("####" if bad else "") for i in range(25)), lang, int(k % 10 != 0)))
    rows.append((None, "w# " * 30, "en", 1))
    frame = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(1, 1), (3, None)], "doc_id long, quality int")
    out = {r["_row"]["doc_id"]: r["kept"] for r in quality_rules.judge(frame, labels).collect() if r["_row"]["doc_id"] is not None}
    for k, _, lang, good in rows[:-1]:
        if not good:
            assert out[k] is (lang == "fr")  # in fr a quarter of the good ones look alike, so nothing may be rejected
        elif lang != "fr":
            assert out[k]
    assert quality_rules.judge(frame.limit(0), labels).count() == 0


@pytest.mark.parametrize("name, sf", [("op2_quality_rules", SF), ("op2_quality_rules_wide", SF2)])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(con.sql(queries.oracle_sql()[name]).select("doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept").fetchall())
    got = queries.queries()[name](spark, sf)
    assert sorted(tuple(r) for r in got.select("doc_id", *quality_rules.BASE, "base_failed", "kept").collect()) == want
    if name == "op2_quality_rules_wide":  # cutoffs are certified, and reject more than the base rules
        assert sum(not kept and not failed for *_, failed, kept in want) > 20


def test_repeated_rows_are_each_judged(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 1)] * 3 + [(None, None, None, None)] * 2, "doc_id long, text string, lang string, `a.b` int")
    labels = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    rows = quality_rules.judge(docs, labels, keep_texts=True).collect()
    assert sorted((r["n_words"], r["kept"]) for r in rows) == [(0, False)] * 2 + [(2, False)] * 3
    assert rows[0]["_row"].asDict().keys() == {"doc_id", "text", "lang", "a.b"}


def test_classifier_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    out = queries.op3_quality_classifier(spark, SF2).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 100
    right = sum(r["predicted"] == r["quality"] for r in out)
    assert right >= 0.95 * len(out)
    assert sum(r["predicted"] == 0 for r in out if r["quality"] == 0) >= 0.8 * sum(r["quality"] == 0 for r in out)


def test_classifier_learns_only_from_positives_of_the_training_folds(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda x: sorted((r["doc_id"], round(r["score"], 9)) for r in quality_classifier.score(docs, x).collect())
    assert key(labels) == key(flipped)


def plain_risk(w, rows, prior, ridge=1e-3):
    """rows: (features, positives, unlabelled); logistic loss, summed one document group at a time."""
    n_p, n_u = sum(r[1] for r in rows), sum(r[2] for r in rows)
    as_positive = as_negative = on_unlabelled = 0.0
    for x, p, u in rows:
        z = sum(a * b for a, b in zip(x, w, strict=True))
        as_positive += p / n_p * math.log1p(math.exp(-z))
        as_negative += p / n_p * math.log1p(math.exp(z))
        on_unlabelled += u / n_u * math.log1p(math.exp(z))
    negative = on_unlabelled - prior * as_negative
    return prior * as_positive + max(0.0, negative) + ridge / 2 * sum(a * a for a in w), negative


def test_risk_is_least_at_the_weights_found():
    rng = np.random.default_rng(3)
    rows = [((float(a), float(b), 1.0), int(rng.integers(1, 9)) * (1 + 20 * a), int(rng.integers(1, 9)) * (1 + 5 * (1 - a) + 4 * a)) for a in (0, 1) for b in (0, 1)]
    x, positive, unlabelled = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    w = quality_classifier.non_negative_risk(x, positive, unlabelled, 0.4)
    best, negative = plain_risk(w, rows, 0.4)
    assert negative > 0
    for _ in range(200):
        assert plain_risk(w + rng.normal(0, 0.3, 3), rows, 0.4)[0] >= best - 1e-4
    assert not quality_classifier.non_negative_risk(x, positive * 0, unlabelled, 0.4).any()


def test_negative_part_is_not_driven_below_zero():
    x, positive, unlabelled = np.eye(3), np.array([5.0, 1, 0]), np.array([5.0, 2, 3])
    w = quality_classifier.non_negative_risk(x, positive, unlabelled, 0.9)  # a prior too high for these counts
    assert plain_risk(w, list(zip(x.tolist(), positive, unlabelled, strict=True)), 0.9)[1] > -0.05


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_class_prior_is_near_the_share_of_positives(share):
    x = np.hstack([np.eye(4), np.ones((4, 1))])
    of_positives, of_negatives = np.array([0.7, 0.2, 0.09, 0.01]), np.array([0.01, 0.04, 0.15, 0.8])
    n = 50_000
    unlabelled = n * (share * of_positives + (1 - share) * of_negatives)
    assert quality_classifier.class_prior(x, n * of_positives, unlabelled) == pytest.approx(share, abs=0.03)
    ratio = [sum(unlabelled[: k + 1]) / n / sum(of_positives[: k + 1]) for k in range(4)]  # cells by falling odds
    assert min(abs(quality_classifier.class_prior(x, n * of_positives, unlabelled) - r) for r in ratio) < 1e-9
    assert quality_classifier.class_prior(x, np.zeros(4), unlabelled) == 0.5


def test_classifier_on_very_long_texts(spark):
    long = " ".join(f"word{k}" for k in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "# " * 300_000), (3, "plain words here")], "doc_id long, text string")
    got = {r["_id"]: r["cell"] for r in quality_classifier.cells(docs, "doc_id", "text").collect()}
    assert len(got) == 3 and len(set(got.values())) == 3
    assert all(0 <= c < 5**7 for c in got.values())


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 3), (2, "a b c", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, quality int")
    rows = quality_classifier.score(docs, labels).collect()
    assert len(rows) == 4
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {round(r["score"], 6) for r in quality_classifier.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), labels).count() == 0


def test_classifier_equals_a_plain_restatement(spark):
    """The whole query again over lists: figures, bins, counts of cells, risk, scores."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    known = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").collect():
        known[r["doc_id"]] = min(r["quality"], known.get(r["doc_id"], 1))
    spaces = re.compile(r"[\x20\x09-\x0D]+")
    cells, counts = {}, {}
    for doc_id, text in docs:
        text = text or ""
        words = [w for w in spaces.split(text) if w]
        lines = [x for x in text.split("\n") if spaces.sub("", x)]
        chars = len(spaces.sub("", text))
        figures = {
            "symbols": 1000 * len(re.findall(r"[#*$%&|<>]", text)) // max(chars, 1), "upper": 1000 * len(re.findall("[A-Z]", text)) // max(chars, 1), "repeated_lines": 1000 * (len(lines) - len(set(lines))) // max(len(lines), 1),
            "stutter": 1000 * sum(a == b for a, b in zip(words, words[1:], strict=False)) // max(len(words), 1), "distinct": 1000 * len(set(words)) // max(len(words), 1), "words": len(words), "word_length": 1000 * chars // max(len(words), 1),
        }
        cell = 0
        for name, cuts in quality_classifier.CUTS.items():
            cell = 5 * cell + sum(figures[name] >= c for c in cuts)
        held = zlib.crc32(str(doc_id).encode()) % 3 == 1
        cells[doc_id] = (cell, held)
        if not held and known.get(doc_id, 1) == 1:
            positive, unlabelled = counts.get(cell, (0, 0))
            counts[cell] = (positive + (doc_id in known), unlabelled + (doc_id not in known))
        elif not held:
            counts.setdefault(cell, (0, 0))
    order = sorted(counts)
    x = quality_classifier.design(np.array(order))
    p, u = (np.array([counts[c][k] for c in order], float) for k in (0, 1))
    w = quality_classifier.non_negative_risk(x, p, u, quality_classifier.class_prior(x, p, u))
    got = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, (cell, held) in cells.items():
        want = 1 / (1 + math.exp(-float((quality_classifier.design(np.array([cell])) @ w)[0])))
        assert got[doc_id]["held_out"] == held and got[doc_id]["score"] == pytest.approx(want, rel=1e-6) and got[doc_id]["predicted"] == int(got[doc_id]["score"] >= 0.5)
