import random

import numpy as np
import pytest

from loomlog.llm import jaccard_join, queries

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def brute(rows, width=3, share=90):
    """rows: (doc_id, text); the sets are compared pair by pair."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else []))
    kinds = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in kinds}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if 100 * len(a) < share * len(b):
                break
            shared = len(a & b)
            if 100 * shared >= share * (len(a) + len(b) - shared) and find(a) is not find(b):
                root[find(a)] = find(b)
    least = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            least[find(s)] = min(d, least.get(find(s), d))
    return sorted(((d, len(s), least.get(find(s)) if s else d) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, SF2])
def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op11_jaccard_join(spark, sf)) == brute(rows)


def family(rng, n, words, edits):
    """Copies of one text with up to ``edits`` words changed, most into words of a few."""
    base = [f"b{rng.randrange(50)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = rng.choice(["x", "y", f"u{rng.randrange(10**6)}"])
        if rng.random() < 0.3:
            own += ["end"] * rng.randrange(1, 4)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("bits", [jaccard_join.BUCKET_BITS, 12])
def test_families_equal_brute_force(spark, bits, monkeypatch):
    """Sets close to the threshold, chains of links, equal prefixes; the order of shingles does not matter."""
    monkeypatch.setattr(jaccard_join, "BUCKET_BITS", bits)
    rng = random.Random(bits)
    texts = [t for words, edits in ((60, 4), (120, 6), (14, 1), (300, 14)) for t in family(rng, 60, words, edits)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard_join.join(docs)) == brute(rows)


def test_a_shared_passage_and_copies(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} {' '.join(f't{i}x{j}' for j in range(i % 7))}") for i in range(150)] + [(1000 + i, passage) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard_join.join(docs)) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(str(i) for i in range(60_000))
    near = long + " one more"
    rows = [
        (1, "a b c d"), (1, "a b c d"), (None, None), (5, ""), (6, " \t\n"), (7, "A B\x0bC\td"), (8, "x"), (9, "X"), (10, "x y"), (11, long), (12, near), (13, near),
        (None, "x y"), (None, "lone"), (14, "É b c d"), (15, "é b c d"), (16, "a b c d"), (17, "a b c d"),
    ]
    docs = spark.createDataFrame([(*r, 1, "n", b"s") for r in rows], "doc_id long, text string, component_id int, n string, sig binary")
    assert result(jaccard_join.join(docs)) == brute(rows)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_one_of_each_component_stays(spark):
    rng = random.Random(6)
    rows = [*enumerate(family(rng, 50, 80, 9)), (None, "a b c d e f"), (None, "a b c d e f"), (200, ""), (201, None), (202, "a b c d e f"), (None, "x y z")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _root string")
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs, width=5, share=(80, 100)).collect()), key=str)
    found = brute(rows[:50], 5, 80)
    want = [(d, dict(rows[:50])[d]) for d, _, c in found if d == c] + [(200, ""), (201, None), (202, "a b c d e f"), (None, "x y z")]
    assert got == sorted(want, key=str) and len(want) < 50


def test_other_shares_and_widths(spark):
    rng = random.Random(4)
    rows = list(enumerate(family(rng, 60, 40, 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard_join.join(docs, share=(1, 1))) == [r for r in sorted(((d, len({tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}), min(e for e, u in rows if u == t)) for d, t in rows), key=str)]


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (9, 60, 127, 128, 300, 511, 512, 5000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        other = np.concatenate((base[n // 10 :], rng.integers(0, 2**63, n // 20).astype(np.uint64)))
        a, b = jaccard_join.sketch(np.unique(base)), jaccard_join.sketch(np.unique(other))
        while len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        assert 0 < np.bitwise_count((a ^ b).view(np.uint64)).sum() <= n // 10 + n // 20 or n < 20
