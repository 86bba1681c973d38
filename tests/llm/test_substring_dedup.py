import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlog.llm import queries, substring_dedup
from loomlog.llm.base import row_keys

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def brute(rows, window=35):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, SF2])
def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert any(r[2] for r in want)
    assert result(queries.op4_substring_dedup(spark, sf)) == want


COMPACT = "mini long, path long, times long, follow long, _key long, _id long, start int, edges int"


def test_paths_compact_where_the_graph_does_not_branch(spark):
    rows = [(1, 1, 5, 2, 7, None, 0, 10), (1, 2, 5, 3, 7, None, 10, 3), (2, 3, 5, 4, 7, None, 13, 4), (4, 4, 2, None, 7, None, 17, 5), (5, 5, 2, None, 7, None, 30, 6), (6, 6, 2, None, 8, 1, 22, 1)]
    frame = spark.createDataFrame(rows, COMPACT)
    got = {r["path"]: (r["ukey"], r["ustart"], r["offset"], r["total"]) for r in substring_dedup.compacted(frame).collect()}
    assert got == {1: (7, 0, 0, 17), 2: (7, 0, 10, 17), 3: (7, 0, 13, 17), 4: (7, 17, 0, 5), 5: (7, 30, 0, 6), 6: (8, 22, 0, 1)}


def test_paths_of_equal_counts_that_part_are_not_compacted(spark):
    rows = [(1, 1, 2, None, 7, None, 0, 10), (2, 2, 2, None, 7, None, 10, 3)]  # 1 goes on to 2 in one text and elsewhere in another
    assert [r["total"] for r in substring_dedup.compacted(spark.createDataFrame(rows, COMPACT)).orderBy("path").collect()] == [10, 3]
    rng = random.Random(9)
    a, b, c, d, e = ([f"{x}{rng.randrange(10**6)}" for _ in range(120)] for x in "abcde")
    docs = [(k, " ".join(x)) for k, x in enumerate((a + b, a + c, d + b, d + c, a + b + e))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = substring_dedup.paths(frame, "doc_id", "text", 35, 12)
    texts = frame.select(*row_keys("doc_id", "text"), F.col("text").alias("_text"))
    spans = substring_dedup.repeated_spans(found, texts, 35, "t").where("digest is not null").collect()
    for r in spans:  # every unit is there whole wherever it begins
        own = docs[r["_id"]][1].encode().split()[r["start"] : r["start"] + r["total"] + 34]
        assert bytes(r["digest"]) == hashlib.sha256(b" ".join(own)).digest()
    assert result(substring_dedup.remove_repeats(frame)) == brute(docs)


def test_texts_meet_by_broadcast_or_shuffle(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MOST_BROADCAST", 0)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(queries.op4_substring_dedup(spark, SF)) == brute(docs)


def test_long_passages_are_one_verified_span(spark, monkeypatch):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    passage = words(400)
    docs = [(k, " ".join(words(60 * k) + passage + words(40))) for k in range(4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = substring_dedup.paths(frame, "doc_id", "text", 35, 12)
    met = found.join(found.groupBy("mini").count().where("count > 1").select("mini"), "mini", "left_semi")
    texts = frame.select(*row_keys("doc_id", "text"), F.col("text").alias("_text"))
    spans = substring_dedup.repeated_spans(met, texts, 35, "t").where("digest is not null").collect()
    longest = {d: max(r["total"] for r in spans if r["_id"] == d) for d in range(4)}
    assert min(longest.values()) > 300 and len(spans) < 20  # 366 edges in paths of at most 24
    for r in spans:
        own = docs[r["_id"]][1].encode().split()[r["start"] : r["start"] + r["total"] + 34]
        assert bytes(r["digest"]) == hashlib.sha256(b" ".join(own)).digest()
    want = brute(docs)
    assert result(substring_dedup.remove_repeats(frame)) == want
    monkeypatch.setattr(substring_dedup, "_digest", lambda words, start, end: random.randbytes(32))  # as if hashes had met by chance
    assert sum(r[2] for r in result(substring_dedup.remove_repeats(frame))) < sum(r[2] for r in want) / 2


def test_branches_repeats_and_edge_cases(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2)
    passage = [word() for _ in range(60)]
    rows = [(None, None), (1, ""), (2, "a " * 100), (3, "a b " * 30), (4, "x"), (5, " ".join(passage)), (5, " ".join(passage)), (None, " \t\n")]
    for k in range(10, 40):
        cut = rng.randint(30, 60)
        rows.append((k, " ".join([word() for _ in range(rng.randint(0, 50))] + passage[60 - cut :] + [word() for _ in range(rng.randint(0, 50))])))
    rows.append((50, " ".join(word() for _ in range(20_000))))
    frame = spark.createDataFrame([(*r, 0, "m") for r in rows], "doc_id long, text string, start int, mini string")
    assert result(substring_dedup.remove_repeats(frame)) == brute(rows)
    assert result(substring_dedup.remove_repeats(frame, window=10, core=4)) == brute(rows, 10)
    assert substring_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_only_whole_units_are_verified():
    words = [f"w{k}".encode() for k in range(60)]
    row = lambda start, edges, unit, offset, total=None, digest=None, bits=None: {"start": start, "edges": edges, "bits": bits, "unit": unit, "offset": offset, "total": total, "digest": digest}
    good = substring_dedup._digest(words, 0, 30)
    gone = lambda *rows: substring_dedup._covered(words, list(rows), 10).nonzero()[0].tolist()
    whole = [row(0, 12, 1, 0, 21, good), row(12, 9, 1, 12)]
    assert gone(*whole) == gone(*whole, *whole) == list(range(30))
    assert gone(row(0, 12, 1, 0, 21, b"other"), whole[1]) == []
    assert gone(row(0, 12, 1, 0, 21, b"other"), row(12, 9, 2, 0)) == list(range(30))  # another passage follows: the unit is not there whole
    assert gone(row(5, 4, None, None, bits=0b1001)) == [*range(5, 18)]
    assert gone(row(50, 1, None, None, bits=1)) == list(range(50, 60))
