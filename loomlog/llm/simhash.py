"""SimHash near-duplicates: pigeonring candidates, full Hamming check, components.

Fingerprints are deduplicated first, so copies never meet as pairs. The 64 bits of a fingerprint form a ring of
``SEGMENTS`` equal segments. Two fingerprints within ``MAX_BITS`` have a start on the ring from which every
chain of l segments differs in at most l * MAX_BITS / SEGMENTS bits (the pigeonring principle, Qin and Xiao
2018). The longest chain with a budget below one must agree and is the join key. Of the longest chain with a budget below two, what
lies beyond the first differs in one bit at most, so one of its halves agrees, and of the other half all segments but one:
a key that many fingerprints share is cut finer, first by the half, then by the segments as well. The last keys leave two segments
open, so at most ``CROWD`` different fingerprints share one. The budgets of all chains prune what shares a key before
the full check, and of each group only so many links go on as hold it together.
"""

from __future__ import annotations

import xxhash
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.base import every, materialize, named, only_rows, passing, row_keys, same_row
from loomlog.llm.components import components

MAX_BITS = 2
SEGMENTS = 16
#: So many fingerprints are compared at once: as many as two open segments of four bits allow.
CROWD = 256
_WIDE = 64 // SEGMENTS
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> bytes:
    """Majority of the XXH64 bits of the word shingles; eight zero bytes without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, len(starts), _BLOCK):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : k + _BLOCK].tolist(), ends[k : k + _BLOCK].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(starts)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``_id, _key, _fp`` (64 bits as a long) for every row."""

    def run(batches):
        for batch in batches:
            bits = [int.from_bytes(fingerprint(x.as_py(), width), "big", signed=True) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int64())], names=["_id", "_key", "_fp"])

    narrow = docs.select(*row_keys(id_col, text_col), named(text_col).alias("_text"))
    return narrow.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _key long, _fp long")


def _turned(value: Column, bits: Column) -> Column:
    """Rotates 64 bits to the right."""
    return F.call_function("shiftrightunsigned", value, bits).bitwiseOR(F.call_function("shiftleft", value, F.lit(64) - bits))


def _ones(first: int, end: int) -> int:
    """The bits of the segments ``first`` to ``end``, exclusive, from the start of the chain."""
    return (1 << (_WIDE * end)) - (1 << (_WIDE * first))


def _chains() -> dict[int, int]:
    """Budget in bits: the longest chain under it."""
    return {length * MAX_BITS // SEGMENTS: length for length in range(1, SEGMENTS + 1)}


def _levels() -> list[list[int]]:
    """For each level, the masks whose bits agree from the right start; the masks of the next level refine them in order."""
    none, one = _chains()[0], _chains()[1]
    middle = (none + one) // 2
    halves = [range(none, middle), range(middle, one)]
    first, second, third = _ones(0, none), [], []
    for same, other in (halves, halves[::-1]):
        half = first | _ones(same.start, same.stop)
        second.append(half)
        third += [half | sum(_ones(k, k + 1) for k in other if k != open_one) for open_one in other]
    return [[first], second, third]


def _linked(rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rotated fingerprints that share a key, those to link: a forest over all pairs within the budgets of all chains."""
    n = len(rings)
    differ = rings[:, None] ^ rings[None, :]
    close = np.ones((n, n), bool)
    for budget, length in _chains().items():
        close &= np.bitwise_count(differ & np.uint64(_ones(0, length))) <= budget
    root = np.arange(n)
    while True:  # the least place in reach, step by step
        least = np.where(close, root[None, :], n).min(axis=1)
        if np.array_equal(least, root):
            break
        root = least
    rest = np.flatnonzero(root != np.arange(n))
    return rest, root[rest]


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, b``: fingerprints within ``MAX_BITS`` by way of others, enough of them to connect all that are (``prints``: distinct ``_fp``).

    Keys that more than ``crowd`` share are refined; the finest are never shared by more than ``CROWD``.
    """

    def run(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for turn, group in zip(batch.column("_turn").to_pylist(), batch.column("_all"), strict=True):
                rings = np.sort(group.values.to_numpy()).view(np.uint64)
                back = (rings << np.uint64(turn)) | (rings >> np.uint64(64 - turn)) if turn else rings
                one, other = _linked(rings)
                a.append(back[one].view(np.int64))
                b.append(back[other].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    turns = F.explode(F.sequence(F.lit(0), F.lit(64 - _WIDE), F.lit(_WIDE))).alias("_turn")
    rows = prints.select("_fp", turns).select("_turn", _turned(F.col("_fp"), F.col("_turn")).alias("_ring"), F.lit(0).alias("_mask"))
    levels, found = _levels(), []
    for depth, masks in enumerate(levels):
        finer = len(masks) // (len(levels[depth - 1]) if depth else 1)
        kinds = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
        keyed = rows.select("_turn", "_ring", (F.col("_mask") * finer).alias("_first"))
        keyed = keyed.select("_turn", "_ring", F.explode(F.sequence("_first", F.col("_first") + finer - 1)).alias("_mask"))
        keyed = keyed.withColumn("_seg", F.col("_ring").bitwiseAND(F.get(kinds, F.col("_mask"))))
        shared = keyed.groupBy("_turn", "_mask", "_seg").agg(F.count("*").alias("_n")).where("_n > 1")
        shared = materialize(shared, "simhash-shared")  # a bare exchange on either side lets a crowded key be split
        met = materialize(keyed.join(shared, ["_turn", "_mask", "_seg"]), "simhash-met")
        last = depth == len(levels) - 1
        few = met if last else met.where(F.col("_n") <= crowd)
        found.append(few.groupBy("_turn", "_mask", "_seg").agg(F.collect_list("_ring").alias("_all")).select("_turn", "_all").mapInArrow(run, "a long, b long"))
        rows = met.where(F.col("_n") > crowd).select("_turn", "_ring", "_mask")
        if last or shared.where(F.col("_n") > crowd).isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, crowd: int = CROWD) -> DataFrame:
    """Returns the id column, fingerprint and component_id (smallest id reachable over links, itself included),
    ``_key``, the hash of id and text that tells rows of one id apart, and ``_root``, the component's least fingerprint.

    Null and empty texts have fingerprint zero and are linked like any other; a null id stays null and counts for
    no component's smallest id (a component of null ids only has a null component_id); repeated rows each have
    their row; other columns are not looked at; no rows give no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = prints.groupBy("_fp").agg(F.min("_id").alias("_first"))
    found = components(links(classes.select("_fp"), crowd), "simhash-links")
    rooted = classes.join(found, classes["_fp"] == found["node"], "left").select("_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    known = rooted.join(least, "_root").select(F.col("_fp").alias("_class"), "_root", "component_id")
    out = prints.join(known, prints["_fp"] == known["_class"])
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", "_key", "_root")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, one of each component: the one of the smallest id, null ids last; repeated rows once."""
    with passing() as keep:  # tables that led to the components go before the rows are read
        found = keep(materialize(near_duplicates(docs, id_col=id_col, text_col=text_col, **how).select(named(id_col).alias("_id"), "_key", "_root"), "simhash-found"))
    kept = found.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_key")).alias("_one")).select("_one._id", "_one._key")
    kept = materialize(kept, "simhash-kept")
    rest = materialize(same_row(found.select("_id", "_key"), kept, "left_anti"), "simhash-rest")
    out = only_rows(docs.select(*row_keys(id_col, text_col), every(docs).alias("_row")), kept, rest)
    if not found.groupBy("_id", "_key").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["_id", "_key"])
    return out.select("_row.*")
