import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomlog.llm import packing, queries
from loomlog.llm.tokenizer import tokenizer

SF = "/root/testdata/sf0.001"
reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return reference.encode(text or "", add_special_tokens=False).ids + [2]


def first_fit_decreasing(lengths, room):
    bins = []
    for x in sorted(lengths, reverse=True):
        for k, left in enumerate(bins):
            if left >= x:
                bins[k] -= x
                break
        else:
            bins.append(room - x)
    return len(bins)


def check(rows, docs, most):
    """docs: (doc_id, text); rows: the result. Pieces give the documents back, and sequences are gapless and full enough."""
    want = []
    for doc_id, text in docs:
        ids = ids_of(text)
        cuts = list(range(len(ids) - most, 0, -most))[::-1]
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ids)], strict=True)):
            want.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    assert len(bins) <= first_fit_decreasing([w[3] for w in want], most)


def test_query_is_an_exact_packing(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(queries.op10_best_fit_packing(spark, SF).collect(), docs, 1024)


def test_edge_cases(spark):
    docs = [(1, None), (1, None), (None, ""), (2, "word " * 3000), (3, "a b"), (3, "a b"), (4, "x" * 50_000), (5, "<|endoftext|> it's　 \x85 \x1c é")]
    frame = spark.createDataFrame([(*d, 0, "o") for d in docs], "doc_id long, text string, piece int, offset string")
    for most in (16, 1024):
        check(packing.pack(frame, max_tokens=most).collect(), docs, most)
    assert packing.pack(frame.limit(0)).count() == 0


PARTS = [*"abÉéæŵ '\t\n\x0b 12.,-_×² Ж日$", "<|endoftext|>", "<|", "|>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), max_size=5))
def test_ids_are_those_of_the_library(texts):
    got = tokenizer().encode(texts)
    assert [x.tolist() for x in got] == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_text_is_the_callers_choice(spark):
    assert tokenizer().encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]
    assert 50256 not in tokenizer(None, True).encode(["a <|endoftext|> b"])[0]
    frame = spark.createDataFrame([("one", "a <|endoftext|> b"), (None, "x")], "`doc.id` string, text string")
    rows = {r["doc_id"]: r["length"] for r in packing.pack(frame, id_col="doc.id").collect()}
    assert rows == {"one": 5, None: 2}
    assert {r["doc_id"]: r["length"] for r in packing.pack(frame, id_col="doc.id", special_text=True).collect()}["one"] > 5


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=12))
def test_patterns_use_the_histogram_up(histogram):
    left = dict(histogram)
    for pattern, times in packing.bin_patterns(histogram, 40):
        assert 0 < sum(x * k for x, k in pattern.items()) <= 40
        for x, k in pattern.items():
            left[x] -= k * times
    assert not any(left.values())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=6), st.integers(0, 60))
def test_the_fullest_combination_is_found(counts, room):
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
    found = packing.fullest(counts, room)
    assert sum(x * k for x, k in found.items()) == max(sums)
    assert all(k <= counts[x] for x, k in found.items())


def test_batches_are_cut_by_bytes_and_whole():
    texts = [None, "", "é" * 60, "a" * 300, None, "b", "c" * 99, ""] * 3
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["_id", "_text"])
    few = list(packing._by_bytes(batch, 100))
    assert [x for b in few for x in b.column(1).to_pylist()] == texts and [x for b in few for x in b.column(0).to_pylist()] == list(range(len(texts)))
    assert all(sum(len((x or "").encode()) for x in b.column(1).to_pylist()[1:]) <= 100 for b in few)  # all but the first, which may be longer
    assert len(list(packing._by_bytes(batch))) == 1 and not list(packing._by_bytes(batch.slice(0, 0)))
    assert len(list(packing._by_bytes(batch.slice(2, 1), 100))) == 1
