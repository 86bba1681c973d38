"""Repeated long passages, found on the De Bruijn graph of token k-mers.

The edges of the graph are the windows of ``window`` words; an edge that occurs twice is repeated text. Edges are
not shuffled one by one. Each belongs to its minimizer, the ``core``-word string with the least hash inside it, and
consecutive edges of a text that share a minimizer are one path (a super-k-mer). Equal edges share the minimizer, so:

1. paths whose minimizer occurs once hold no repeated edge and leave (a count and a join);
2. a path that occurs twice is repeated text, all its edges alike. Such paths are compacted by joins: where one ends in its source the next begins, the
   next follows it at all its occurrences, and both occur equally often, the graph does not branch between them, and they are one unit, the longer the passage the fewer rows;
3. where paths of a minimizer differ, the graph branches: one source of each different path, named by its
   coordinates, is read again, its edges are counted one by one, and the result is kept as a bit per edge;
4. units and paths join back to the coordinates of all their occurrences. Where a text holds a whole unit, the long span is verified: the SHA-256 of its words
   must be that of the unit's words, read at the coordinates of its source. Then each text drops the words covered.

Parts of units, and the edges of branching paths, rest on the 64-bit hashes of minimizer and path or window. No step collects the
occurrences of a path or edge; lists exist per text only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.base import drop, materialize, named, row_keys, same_row
from loomlog.llm.rolling import RunHasher

_CHUNK = 400_000  # words hashed at once; bounds the memory, not the result


_NO_PATHS = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, bool)]
#: Keys of texts that lose words are broadcast up to so many, so that the other texts are not shuffled.
MOST_BROADCAST = 1_000_000


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` consecutive values, the first on ties."""
    place, have = np.arange(len(values)), 1
    while have < width:
        by = min(have, width - have)
        left, right = place[:-by], place[by:]
        place = np.where(values[left] <= values[right], left, right)
        have += by
    return place


def _paths(hasher: RunHasher, sizes: list[int], window: int, core: int):
    """Of texts with so many words each, loaded one after another: text, start in it, edges, minimizer, hash of the path, and whether the next path goes on from it."""
    sizes = np.array(sizes, np.int64)
    total = int(sizes.sum())
    if total < window:
        return _NO_PATHS
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    cores = hasher.of(np.arange(total - core + 1), core)
    place = _leftmost_least(cores, window - core + 1)
    valid = np.arange(len(place)) + window <= ends[: len(place)]
    at = np.flatnonzero(valid)
    if not len(at):
        return _NO_PATHS
    mine = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    edges = np.diff(first, append=len(at))
    start = at[first]
    text = owner[start]
    goes_on = np.append((start[1:] == start[:-1] + edges[:-1]) & (text[1:] == text[:-1]), False)
    return text, start - (np.cumsum(sizes) - sizes)[text], edges, cores[mine[first]], hasher.of(start, edges + window - 1), goes_on


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def paths(docs: DataFrame, id_col: str, text_col: str, window: int, core: int) -> DataFrame:
    """A row for each path of each text: ``_id, _key, start, edges, mini, path`` and ``next``, the path that goes on from it in the text, if one does."""

    def run(batches):
        hasher = RunHasher()
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            k = 0
            while k < batch.num_rows:
                begin, sizes, words = k, [], []
                while k < batch.num_rows and (not words or len(words) < _CHUNK):
                    own = (texts[k].as_py() or "").encode().split()
                    words += own
                    sizes.append(len(own))
                    k += 1
                hasher.load(words)
                text, start, edges, mini, path, goes_on = _paths(hasher, sizes, window, core)
                row, after = pa.array(text + begin), pa.array(np.roll(path, -1).view(np.int64), mask=~goes_on)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), keys.take(row), pa.array(start.astype(np.int32)), pa.array(edges.astype(np.int32)), _signed(mini), _signed(path), after],
                    names=["_id", "_key", "start", "edges", "mini", "path", "next"],
                )

    narrow = docs.select(*row_keys(id_col, text_col), named(text_col).alias("_text"))
    return narrow.mapInArrow(run, f"{_id_type(docs, id_col)}, _key long, start int, edges int, mini long, path long, next long")


def _id_type(docs: DataFrame, id_col: str) -> str:
    return f"_id {docs.schema[id_col].dataType.simpleString()}"


def _digest(words: list[bytes], start: int, end: int) -> bytes:
    return hashlib.sha256(b" ".join(words[start:end])).digest()


_READ = "mini long, path long, place int, edge long, times long, ukey long, ustart int, digest binary"


def _read(sources: DataFrame, window: int) -> DataFrame:
    """What the sources hold at the coordinates named: the edges of ``_paths`` one by one, and the digests of ``_units``."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in _READ.split(", ")]

    def rows(have: dict) -> pa.RecordBatch:
        n = len(next(iter(have.values())))
        return pa.RecordBatch.from_arrays([pa.array(have[c], k) if c in have else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def edges(hasher: RunHasher, words: list[bytes], opened: list[dict]) -> list[np.ndarray]:
        hasher.load(words)
        many = np.array([x["edges"] for x in opened], np.int64)
        row = np.repeat(np.arange(len(opened)), many)
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = np.array([x["start"] for x in opened], np.int64)[row] + place
        mini, path, times = (np.array([x[c] for x in opened], np.int64)[row] for c in ("mini", "path", "times"))
        return [mini, path, place.astype(np.int32), hasher.of(start, window).view(np.int64), times]

    def run(batches):
        hasher, found, held, digests = RunHasher(), [], 0, {"ukey": [], "ustart": [], "digest": []}
        for batch in batches:
            for text, opened, units in zip(batch.column("_text"), batch.column("_paths"), batch.column("_units"), strict=True):
                words, opened = (text.as_py() or "").encode().split(), opened.as_py()
                if opened:
                    found.append(edges(hasher, words, opened))
                    held += len(found[-1][0])
                for x in units.as_py() or ():
                    digests["ukey"].append(x["ukey"])
                    digests["ustart"].append(x["ustart"])
                    digests["digest"].append(_digest(words, x["ustart"], x["ustart"] + x["total"] + window - 1))
                if held >= _CHUNK:
                    yield rows(dict(zip(names, map(np.concatenate, zip(*found, strict=True)))))
                    found, held = [], 0
            if digests["ukey"]:
                yield rows(digests)
                digests = {"ukey": [], "ustart": [], "digest": []}
        if found:
            yield rows(dict(zip(names, map(np.concatenate, zip(*found, strict=True)))))

    return sources.select("_text", "_paths", "_units").mapInArrow(run, _READ)


def compacted(repeated: DataFrame) -> DataFrame:
    """``mini, path, ukey, ustart, offset, total``: the unit of each repeated path, named by the coordinates of its source, and the path's place in it.

    ``repeated`` has mini, path, times, ``follow``, the one path that goes on from all its occurrences, if there is one, and the coordinates of one source: _key, _id, start, edges.
    The graph does not branch between a path and the next if that one follows it everywhere and occurs no more often: then it is preceded by it everywhere, too.
    """
    ends = repeated.select(F.col("_key").alias("_k"), F.col("_id").alias("_i"), (F.col("start") + F.col("edges")).alias("_s"), F.col("times").alias("_t"), F.col("follow").alias("_f"))
    same_place = (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")) & (F.col("start") == F.col("_s"))
    goes_on = same_place & (F.col("times") == F.col("_t")) & (F.col("path") == F.col("_f"))
    linked = repeated.join(ends, goes_on, "left").withColumn("_head", F.when(F.col("_s").isNull(), F.col("start")))
    along = Window.partitionBy("_key", "_id").orderBy("start")  # within one text
    units = linked.withColumn("ustart", F.last("_head", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = F.sum("edges").over(Window.partitionBy("_key", "_id", "ustart"))
    return units.select("mini", "path", F.col("_key").alias("ukey"), "_id", "ustart", (F.col("start") - F.col("ustart")).alias("offset"), total.cast("int").alias("total"))


def repeated_spans(met: DataFrame, texts: DataFrame, window: int, name: str) -> DataFrame:
    """``_key, _id, start, edges, bits, unit, offset, total, digest``: repeated edges of the texts, a row a path; all of its edges unless ``bits`` tells which.

    A path of a unit has its place there in ``offset``, and the first one the unit's edges in ``total`` and the digest of its words.
    """
    follow = F.when((F.count("next") == F.count("*")) & (F.min("next") == F.max("next")), F.min("next"))
    whole = met.groupBy("mini", "path").agg(F.count("*").alias("times"), F.min(F.struct("_key", "_id", "start", "edges")).alias("at"), follow.alias("follow"))
    whole = materialize(whole, f"{name}-different")
    at = [F.col(f"at.{c}").alias(c) for c in ("_key", "_id", "start", "edges")]
    units = materialize(compacted(whole.where("times > 1").select("mini", "path", "times", "follow", *at)), f"{name}-units")
    branching = whole.groupBy("mini").agg(F.count("*").alias("_n"), F.min("times").alias("_least")).where("_n > 1 and _least = 1").select("mini")
    open_paths = whole.join(materialize(branching, f"{name}-branching"), "mini", "left_semi")

    path = F.struct("start", "edges", "mini", "path", "times")
    unit = F.struct("ukey", "ustart", "total")
    wanted = open_paths.select(*at, "mini", "path", "times").select("_key", "_id", path.alias("p"), F.lit(None).cast("struct<ukey:long,ustart:int,total:int>").alias("u"))
    wanted = wanted.unionByName(units.where("offset = 0").select(F.col("ukey").alias("_key"), "_id", unit.alias("u")), allowMissingColumns=True)
    sources = materialize(wanted.groupBy("_key", "_id").agg(F.collect_list("p").alias("_paths"), F.collect_list("u").alias("_units")), f"{name}-named")
    read = materialize(_read(same_row(sources, texts, "inner"), window), f"{name}-read")

    edges = read.where("mini is not null")
    digests = read.where("ukey is not null").select("ukey", "ustart", "digest").dropDuplicates(["ukey", "ustart"])
    due = sources.agg(F.sum(F.aggregate("_paths", F.lit(0).cast("long"), lambda n, x: n + x["edges"]))).first()[0] or 0
    if edges.count() != due:  # repeated rows: a source was read more than once
        edges = materialize(edges.dropDuplicates(["mini", "path", "place"]), f"{name}-edges")
    twice = edges.groupBy("mini", "edge").agg(F.sum("times").alias("_n")).where("_n > 1").select("mini", "edge")
    some = edges.join(materialize(twice, f"{name}-twice"), ["mini", "edge"]).groupBy("mini", "path").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    single = whole.where("times = 1").select(*at, "mini", "path").join(some, ["mini", "path"])

    unit = F.xxhash64("ukey", "ustart").alias("unit")
    heads = units.where("offset = 0").join(digests, ["ukey", "ustart"], "left").select("mini", "path", unit, "offset", "total", "digest")
    known = heads.unionByName(units.where("offset > 0").select("mini", "path", unit, "offset"), allowMissingColumns=True)
    known = materialize(known, f"{name}-known")  # a bare exchange on either side lets a path of many occurrences be split
    placed = met.join(known, ["mini", "path"]).select("_key", "_id", "start", "edges", F.lit(None).cast("long").alias("bits"), "unit", "offset", "total", "digest")
    return placed.unionByName(single.select("_key", "_id", "start", "edges", "bits"), allowMissingColumns=True)


def _covered(words: list[bytes], rows: list[dict], window: int) -> np.ndarray:
    """Which words of a text go. A unit that is there whole but whose words are not those of its source stays."""
    edges = np.zeros(max(1, len(words) - window + 1), bool)
    held: dict[tuple[int, int], int] = {}  # a unit and where it would begin: its edges that are there
    for start, length, unit, offset in {(x["start"], x["edges"], x["unit"], x["offset"]) for x in rows if x["bits"] is None}:
        edges[start : start + length] = True
        held[unit, start - offset] = held.get((unit, start - offset), 0) + length
    for x in rows:
        start, total = x["start"], x["total"]
        if x["digest"] is not None and held[x["unit"], start] == total and _digest(words, start, start + total + window - 1) != x["digest"]:
            edges[start : start + total] = False
    for x in rows:
        for k in range((x["bits"] or 0).bit_length()):
            edges[x["start"] + k] |= bool(x["bits"] >> k & 1)
    at = np.flatnonzero(edges)
    change = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, core: int = 12) -> DataFrame:
    """Returns the id, n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every word covered by a window that also starts elsewhere goes, all
    its copies alike. Null and empty texts have no words and an empty kept text; a null id stays null; repeated rows are
    repeats of each other; texts shorter than a window are kept; very long texts are read whole, some hundred thousand words at a time; other columns are not looked at; no rows give none.
    """
    if not 0 < core <= window or window - core + 1 > 63:
        raise ValueError("core must be positive and window - core at most 62")
    found = materialize(paths(docs, id_col, text_col, window, core), "paths")
    shared = found.groupBy("mini").agg(F.count("*").alias("_n")).where("_n > 1").select("mini")
    shared = materialize(shared, "paths-shared")  # a bare exchange on either side lets a hot minimizer be split
    met = materialize(found.join(shared, "mini", "left_semi"), "paths-met")
    drop(found, shared)
    texts = docs.select(*row_keys(id_col, text_col), named(text_col).alias("_text"))
    gone = repeated_spans(met, texts, window, "paths").groupBy("_key", "_id").agg(F.collect_list(F.struct("start", "edges", "bits", "unit", "offset", "total", "digest")).alias("_gone"))
    gone = materialize(gone, "paths-gone")

    def run(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("_text"), batch.column("_gone"), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = gone.as_py()
                goes = _covered(words, gone, window) if gone else np.zeros(0, bool)
                n_removed = int(goes.sum())
                kept = b" ".join([w for w, g in zip(words, goes.tolist(), strict=True) if not g] if n_removed else words)
                out.append((len(words), n_removed, kept.decode(), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    schema = f"{_id_type(docs, id_col)}, n_words long, n_removed long, kept_text string, kept_sha256 string"
    if gone.count() <= MOST_BROADCAST:  # texts that keep all words stay where they are
        keys = F.broadcast(gone.select("_key", "_id"))
        whole = same_row(texts, keys, "left_anti").withColumn("_gone", F.lit(None).cast(gone.schema["_gone"].dataType))
        both = whole.unionByName(same_row(same_row(texts, keys, "left_semi"), gone, "inner"))
    else:
        both = same_row(texts, gone, "left")
    return both.select("_id", "_text", "_gone").mapInArrow(run, schema).withColumnRenamed("_id", id_col)
