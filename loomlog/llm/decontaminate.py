"""Benchmark decontamination: seeds that no alignment can do without, then Smith-Waterman alignment.

Texts are cut into lower-case words without ASCII punctuation. Seeds are pairs of item words, neighbours or one word apart,
that stand next to each other or one word apart in a text. Of an alignment with m matches and e edits (score 2m - e), all but
the gaps of two edits or more between matches are seeds; so the seeds of a score of t weigh t - 2 at least, where a pair without an
edit weighs 2 and one with an edit 1. Items that one matched word brings to the least score have single words as seeds. Those parts of a text that hold enough seeds of an item are aligned with it, alike parts once a task. While the seeds are few,
tasks look them up as they read the texts; beyond that, each item keeps the rarest of its seeds, so many that no alignment can do without all of them; the texts'
seeds that pass a bitmap of a fixed size meet these in a join, and the same parts are aligned.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.base import every, materialize, named, row_keys, same_row

#: The seeds that tasks look up are broadcast up to this many (13 bytes each); beyond, they are joined.
MOST_BROADCAST = 4_000_000
#: The bitmap that texts' seeds pass before the join has so many bits, as a power of two (8 MB).
BITMAP = 26
#: So many texts tell, beside the items, which seeds are frequent, and one of them counts for so many items.
SAMPLED_TEXTS, SAMPLE_WEIGHT = 2_000, 1_000
#: Alignments that a task remembers, so that alike parts are aligned once.
MOST_KNOWN = 20_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_BLANK).split()


def word_hashes(text: str | None) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, plain_words(text))), np.uint64)


def _best(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """Score of the best local alignment of word hashes, and where its span ends in ``a``."""
    slope = -gap * np.arange(len(a) + 1)
    row, top, end = np.zeros(len(a) + 1, np.int64), 0, 0
    for word in b:
        now = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(a == word, match, mismatch), row[1:] + gap, out=now[1:])
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + slope) - slope  # gaps in the item
        k = int(row.argmax())
        if row[k] > top:
            top, end = int(row[k]), k
    return top, end


def align(passage: np.ndarray, item: np.ndarray, least: int = 0) -> tuple[int, int, int]:
    """Best local alignment of word hashes: score, and start and end of its span in ``passage`` (end exclusive; 0 and 0 under the score ``least``)."""
    score, end = _best(passage, item)
    if score < least:
        return score, 0, 0
    _, back = _best(passage[:end][::-1], item[::-1])
    return score, end - back, end


def _least(n_words: int, least_score: float) -> int:
    """The score that an alignment with an item of so many words must reach."""
    return math.ceil(2 * n_words * least_score - 1e-6)


def _seeds(words: np.ndarray, apart: int) -> np.ndarray:
    """A hash for each place of a text: of its word (``apart`` 0), or of the pair it forms with the word so far behind."""
    return words * _C if not apart else (words[:-apart] * _A + words[apart:]) * _B


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct n-grams."""
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _A + words[k : k + len(out)]
    return np.unique(out)


def _item_seeds(words: np.ndarray, least_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The distinct seeds of an item, which of them are neighbours, the most that each can weigh in one alignment, and the weight that an alignment has at least."""
    need = _least(len(words), least_score) - 2
    if need <= 0:
        own = np.unique(_seeds(words, 0))
        return own, np.zeros(len(own), bool), np.ones(len(own), np.int64), 1
    (near, n_near), (far, n_far) = (np.unique(_seeds(words, apart), return_counts=True) for apart in (1, 2))
    own = np.concatenate((near, np.setdiff1d(far, near)))
    most = np.concatenate((2 * n_near, np.zeros(len(own) - len(near), np.int64)))
    order = np.argsort(own)
    most[order[np.searchsorted(own, far, sorter=order)]] += n_far
    return own, np.arange(len(own)) < len(near), most, need


def _hashed(frame: DataFrame, kinds: str) -> DataFrame:
    """The other columns and ``words``, the hashes of the words of the last column; rows without words are left out."""

    def run(batches):
        for batch in batches:
            words = [word_hashes(text.as_py()).view(np.int64) for text in batch.columns[-1]]
            rows = batch.take(pa.array([k for k, own in enumerate(words) if len(own)], pa.int64()))
            lists = pa.array([own for own in words if len(own)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], names=[*rows.schema.names[:-1], "words"])

    return frame.mapInArrow(run, f"{kinds}, words array<long>")


class _Aligner:
    """Score, start, end and shared n-grams of a part of a text and an item, if the score is the least one at all; alike parts are aligned once."""

    def __init__(self, size: int, least_score: float):
        self.size, self.least_score, self.known = size, least_score, {}

    def __call__(self, passage: np.ndarray, item: np.ndarray, ikey: int) -> tuple[float, int, int, int] | None:
        key = (ikey, passage.tobytes())
        if key not in self.known:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            least = _least(len(item), self.least_score)
            score, low, high = align(passage, item, least)
            if score < least:
                self.known[key] = None
            else:
                shared = np.isin(_runs(item, self.size), _runs(passage, self.size)).sum() if len(passage) >= min(self.size, len(item)) else 0
                self.known[key] = (score / (2 * len(item)), low, high, int(shared))
        return self.known[key]


class _Index:
    """The seeds of all items, sorted, and the items of each."""

    def __init__(self, keys: np.ndarray, items: list[np.ndarray], least_score: float):
        self.keys, self.items = keys, items
        each = [_item_seeds(w, least_score) for w in items]
        self.need = np.array([x[3] for x in each], np.int64)
        self.span = np.array([3 * len(w) - _least(len(w), least_score) for w in items], np.int64)  # m + e <= 3m - t
        seeds = np.concatenate([x[0] for x in each])
        order = np.argsort(seeds, kind="stable")
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), [len(x[0]) for x in each])[order]
        self.near = np.concatenate([x[1] for x in each])[order]
        self.most = np.concatenate([x[2] for x in each])[order]
        self.seeds, first = np.unique(seeds[order], return_index=True)
        self.first = np.append(first, len(seeds))
        self.aparts = [x for x, used in ((0, any(_least(len(w), least_score) <= 2 for w in items)), (1, True), (2, True)) if used]
        bits = max(16, min(26, 4 + len(self.seeds).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)  # by the first bits of the hash
        self.maybe[self.seeds >> self.shift] = True

    def parts(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Item, start and end of the parts of a text that may hold an alignment of the least score.

        An alignment meets each pair of the item once, so a seed weighs no more than its pairs in the item, however often the text repeats it: first over
        the whole text, by its distinct seeds, then, for the few items left, part by part.
        """
        at, found, beside = [], [], []
        for apart in self.aparts:
            if len(words) <= apart:
                continue
            each = _seeds(words, apart)
            place = np.flatnonzero(self.maybe.take((each >> self.shift).view(np.int64)))
            seed = np.minimum(np.searchsorted(self.seeds, each[place]), len(self.seeds) - 1)
            hit = self.seeds[seed] == each[place]
            at.append(place[hit])
            found.append(seed[hit])
            beside.append(np.full(len(at[-1]), apart == 1))
        if not sum(map(len, at)):
            return []
        at, found, beside = (np.concatenate(x) for x in (at, found, beside))
        distinct, code = np.unique(found, return_inverse=True)
        near, far = np.bincount(code, beside, len(distinct)), np.bincount(code, ~beside, len(distinct))
        n = self.first[distinct + 1] - self.first[distinct]
        own = np.repeat(np.arange(len(distinct)), n)
        row = np.repeat(self.first[distinct] - np.cumsum(n) + n, n) + np.arange(n.sum())
        items, item = np.unique(self.item[row], return_inverse=True)
        total = np.bincount(item, np.minimum(near[own] * (1 + self.near[row]) + far[own], self.most[row]))
        out = []
        for no in np.flatnonzero(total >= self.need[items]).tolist():
            k, mine = int(items[no]), item == no
            row_of = np.full(len(distinct), -1)
            row_of[own[mine]] = row[mine]
            rows = row_of[code]
            hit = rows >= 0
            out += [(k, low, high) for low, high in self._parts_of(k, at[hit], rows[hit], 1 + (self.near[rows[hit]] & beside[hit]), len(words))]
        return out

    def _parts_of(self, k: int, at: np.ndarray, rows: np.ndarray, weight: np.ndarray, n_words: int) -> list[tuple[int, int]]:
        """The parts for one item, from the places, seeds and weights of its hits."""
        order = np.lexsort((-weight, at))
        at, rows, weight = at[order], rows[order], weight[order]
        place, first = np.unique(at, return_index=True)
        upto, span, need = np.concatenate(([0], np.cumsum(weight[first]))), int(self.span[k]), self.need[k]
        fits = upto[np.searchsorted(place, place + span)] - upto[:-1] >= need
        parts: list[tuple[int, int]] = []
        for low, high in zip((place[fits] - span).tolist(), (place[fits] + span + 2).tolist(), strict=True):
            low, high = max(low, 0), min(high, n_words)
            if parts and low <= parts[-1][1]:
                parts[-1] = (parts[-1][0], high)
            else:
                parts.append((low, high))

        def enough(low: int, high: int) -> bool:
            inside = slice(np.searchsorted(at, low), np.searchsorted(at, high))
            seeds, code = np.unique(rows[inside], return_inverse=True)
            return np.minimum(np.bincount(code, weight[inside]), self.most[seeds]).sum() >= need

        return [part for part in parts if enough(*part)]


def _scanned(texts: DataFrame, index: _Index, least_score: float, size: int, kinds: str) -> DataFrame:
    """The alignments of every text, by looking its seeds up as it is read."""

    def run(batches):
        aligned = _Aligner(size, least_score)
        for batch in batches:
            pick, rows = [], []
            for k, text in enumerate(batch.column("_text")):
                own = word_hashes(text.as_py())
                for no, low, high in index.parts(own):
                    if found := aligned(own[low:high], index.items[no], no):
                        score, start, end, shared = found
                        pick.append(k)
                        rows.append((index.keys[no], score, low + start, low + end, shared))
            rows = list(zip(*rows, strict=True)) if rows else [()] * 5
            done = [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(pick, pa.int64())) for c in ("_id", "_key")], *done], names=["_id", "_key", "_ikey", "score", "start", "end", "seeds"])

    return texts.mapInArrow(run, f"{kinds}, _ikey long, score double, start int, end int, seeds long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A byte for every eight values of the first ``BITMAP`` bits of a seed, with a bit for each that occurs."""
    width = 1 << 15  # bits of one of Spark's bitmaps
    slot = F.call_function("shiftrightunsigned", F.col("seed"), F.lit(64 - BITMAP))
    parts = seeds.groupBy(F.floor(slot / width).alias("k")).agg(F.bitmap_construct_agg(slot % width).alias("bits"))
    out = np.zeros((1 << BITMAP) // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most 2048 of 4 KB each
        out[r["k"] * width // 8 : (r["k"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _rare(seeds: DataFrame, hashed: DataFrame) -> DataFrame:
    """``_ikey, seed, near, least``: the rarer seeds of each item, and the weight that an alignment has in them at least.

    The most frequent seeds of an item are left out as long as all they can weigh together stays below what an alignment needs, so every alignment
    holds some that stay. How frequent seeds are is told by the items and by a sample of texts; it decides what is joined, not what is found.
    """

    def of_sample(batches):
        for batch in batches:
            for words in batch.column("words"):
                own = words.values.to_numpy().view(np.uint64)
                each = np.unique(np.concatenate([_seeds(own, apart) for apart in range(min(3, len(own)))]))
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64))], names=["seed"])

    sampled = hashed.select("words").limit(SAMPLED_TEXTS).mapInArrow(of_sample, "seed long").groupBy("seed").agg((F.count("*") * SAMPLE_WEIGHT).alias("c"))
    often = materialize(seeds.groupBy("seed").agg(F.count("*").alias("c")).union(sampled.join(seeds.select("seed").distinct(), "seed", "left_semi")).groupBy("seed").agg(F.sum("c").alias("c")), "seed-counts")
    inside = Window.partitionBy("_ikey").orderBy(F.desc("c"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = seeds.join(often, "seed").withColumn("_upto", F.sum("most").over(inside))
    gone = F.max(F.when(F.col("_upto") < F.col("need"), F.col("_upto"))).over(Window.partitionBy("_ikey"))
    return ranked.withColumn("least", F.col("need") - F.coalesce(gone, F.lit(0))).where("_upto >= need").select("_ikey", "seed", "near", "least")


def _joined(hashed: DataFrame, bench: DataFrame, least_score: float, size: int, kinds: str) -> DataFrame:
    """The alignments of every text, by a join on seeds."""

    def of_items(batches):
        for batch in batches:
            for key, words in zip(batch.column("_ikey"), batch.column("words"), strict=True):
                own, near, most, need = _item_seeds(words.values.to_numpy().view(np.uint64), least_score)
                keys, needs = (pa.array([x] * len(own), pa.int64()) for x in (key.as_py(), need))
                yield pa.RecordBatch.from_arrays([keys, pa.array(own.view(np.int64)), pa.array(near), pa.array(most, pa.int64()), needs], names=["_ikey", "seed", "near", "most", "need"])

    wanted = bench.select("_ikey", "words").dropDuplicates(["_ikey"])
    every_seed = materialize(wanted.mapInArrow(of_items, "_ikey long, seed long, near boolean, most long, need long"), "item-seeds")
    seeds = materialize(_rare(every_seed, hashed), "rare-seeds")
    maybe, shift = hashed.sparkSession.sparkContext.broadcast(_bitmap(seeds)), np.uint64(64 - BITMAP)

    def of_texts(batches):
        for batch in batches:
            for k, words in enumerate(batch.column("words")):
                own = words.values.to_numpy().view(np.uint64)
                for apart in range(min(3, len(own))):
                    each = _seeds(own, apart)
                    slot = each >> shift
                    each = each[maybe.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1]
                    seed, n = np.unique(each, return_counts=True)
                    row = batch.slice(k, 1).take(pa.array(np.zeros(len(seed), np.int64)))
                    columns = [row.column("_id"), row.column("_key"), pa.array(seed.view(np.int64)), pa.array(np.full(len(seed), apart == 1)), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "seed", "beside", "n"])

    def run(batches):
        aligned, indexes = _Aligner(size, least_score), {}
        for batch in batches:
            pick, rows = [], []
            for k, (words, item, key) in enumerate(zip(batch.column("words"), batch.column("_words"), batch.column("_ikey").to_pylist(), strict=True)):
                if key not in indexes:
                    if len(indexes) >= 64:
                        indexes.clear()
                    indexes[key] = _Index([key], [item.values.to_numpy().view(np.uint64)], least_score)
                own, index = words.values.to_numpy().view(np.uint64), indexes[key]
                for _, low, high in index.parts(own):
                    if found := aligned(own[low:high], index.items[0], key):
                        score, start, end, shared = found
                        pick.append(k)
                        rows.append((score, low + start, low + end, shared))
            rows = list(zip(*rows, strict=True)) if rows else [()] * 4
            done = [pa.array(v, t) for v, t in zip(rows, (pa.float64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
            own = [batch.column(c).take(pa.array(pick, pa.int64())) for c in ("_id", "_key", "_ikey")]
            yield pa.RecordBatch.from_arrays([*own, *done], names=["_id", "_key", "_ikey", "score", "start", "end", "seeds"])

    texts = hashed.select("_id", "_key", "words").mapInArrow(of_texts, f"{kinds}, seed long, beside boolean, n long")
    weight = F.col("n") * F.when(F.col("near") & F.col("beside"), 2).otherwise(1)
    pairs = texts.join(seeds, "seed").groupBy("_id", "_key", "_ikey").agg(F.sum(weight).alias("w"), F.first("least").alias("least")).where("w >= least")
    pairs = same_row(pairs.select("_id", "_key", "_ikey"), hashed, "inner").join(wanted.withColumnRenamed("words", "_words"), "_ikey")
    return pairs.select("_id", "_key", "_ikey", "words", "_words").mapInArrow(run, f"{kinds}, _ikey long, score double, start int, end int, seeds long")


def leaks(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 3, least_score: float = 0.5
) -> DataFrame:
    """A row for each document and item whose best alignment reaches ``least_score`` of a perfect one.

    Returns the id, ``item_id``, score (1: every word of the item in order), start and end of the span (in words), seeds (distinct runs
    of ``size`` words of the item that stand in the part aligned; an edited copy may have none) and ``_key``, the hash of id and text that tells rows
    of one id apart. Null or empty texts and items match nothing; null ids stay null; repeated rows of docs give one row, as do repeated
    items of one id and text; of equal scores the first span counts; very long texts are aligned by their parts; other columns are not looked at; no rows give no rows.
    """
    narrow = items.select(named(item_col).alias("_item"), named(item_text_col).alias("_text")).dropDuplicates()
    bench = materialize(_hashed(narrow, f"_item {items.schema[item_col].dataType.simpleString()}").withColumn("_ikey", F.xxhash64("words")), "bench")
    kinds = f"_id {docs.schema[id_col].dataType.simpleString()}, _key long"
    texts = docs.select(*row_keys(id_col, text_col), named(text_col).alias("_text"))
    owners = bench.select("_item", "_ikey").distinct()
    if 2 * (bench.agg(F.sum(F.size("words"))).first()[0] or 0) <= MOST_BROADCAST:
        own = bench.select("_ikey", "words").dropDuplicates(["_ikey"]).toArrow()
        found = [w.values.to_numpy().view(np.uint64) for w in own["words"]]
        index = _Index(own["_ikey"].to_pylist(), found or [np.zeros(1, np.uint64)], least_score)
        scored, owners = _scanned(texts if found else texts.limit(0), index, least_score, size, kinds), F.broadcast(owners)
    else:
        scored = _joined(materialize(_hashed(texts, kinds).dropDuplicates(["_id", "_key"]), "texts"), bench, least_score, size, kinds)
    scored = scored.where(F.col("score") >= least_score).join(owners, "_ikey")
    best = scored.groupBy("_id", "_key", "_item").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), "end", "seeds")).alias("b"))
    return best.select(F.col("_id").alias(id_col), F.col("_item").alias("item_id"), "b.score", (-F.col("b.s")).alias("start"), F.col("b.end").alias("end"), F.col("b.seeds").alias("seeds"), "_key")


def drop_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    bad = materialize(leaks(docs, items, id_col=id_col, text_col=text_col, **how).select(named(id_col).alias("_id"), "_key").distinct(), "leaks")
    rows = docs.select(*row_keys(id_col, text_col), every(docs).alias("_row"))
    return same_row(rows, bad, "left_anti").select("_row.*")
