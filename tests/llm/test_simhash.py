import random

import pytest
import xxhash

from loomlog.llm import queries, simhash

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(rows):
    """rows: (doc_id, fingerprint)"""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=str)


def result(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, SF2])
def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute_components([(r["doc_id"], brute_print(r["text"])) for r in docs])
    assert result(queries.op8_simhash_near_dedup(spark, sf)) == want


def test_levels_refine_each_other_and_end_in_few_open_bits():
    first, second, third = simhash._levels()
    assert [len(x) for x in (first, second, third)] == [1, 2, 8]
    assert all(m & first[0] == first[0] for m in second)
    assert all(m & second[k // 4] == second[k // 4] and 64 - m.bit_count() == 8 for k, m in enumerate(third))


def test_no_pair_is_lost_at_any_level(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    for a, b in [(0, 0), (0, 1), (3, 4), (0, 32), (31, 33), (5, 63), (60, 3), (20, 52)] + [(rng.randrange(64), rng.randrange(64)) for _ in range(40)]:
        pair = {base, base ^ (1 << a) ^ (1 << b) if a != b else base ^ (1 << a)}
        turned = [(x >> 4 * t | x << 64 - 4 * t) & (1 << 64) - 1 for t in range(16) for x in sorted(pair)]
        for masks in simhash._levels():
            assert any(len({turned[2 * t] & m, turned[2 * t + 1] & m}) == 1 for t in range(16) for m in masks)


def test_crowded_and_paired_links_give_the_same_components(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "_fp long")
    got = []
    for crowd in (0, 4, 1000):
        found = {(r["node"], r["root"]) for r in simhash.components(simhash.links(frame, crowd=crowd)).collect()}
        got.append(found)
    assert got[0] == got[1] == got[2]
    want = {f: c for _, f, c in brute_components([(s, s & (1 << 64) - 1) for s in signed])}
    groups = {}
    for f, c in want.items():
        groups.setdefault(c, set()).add(f)
    assert len({r for _, r in got[0]}) == sum(len(g) > 1 for g in groups.values())
    assert len(got[0]) == sum(len(g) - 1 for g in groups.values())


def test_edge_cases(spark):
    long = " ".join(str(i) for i in range(70_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (None, None), (5, ""), (6, "A B\x0bC\td"), (7, "x"), (8, long), (9, long), (None, "lone words here now")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, component_id int, _fp string")
    got = result(simhash.near_duplicates(docs))
    assert got == brute_components([(d, brute_print(t)) for d, t in rows])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
