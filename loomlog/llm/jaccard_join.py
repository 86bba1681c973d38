"""N-gram Jaccard join: a grouped prefix join over the documents' sets of word shingles.

Texts with equal sets are one set first. Shingles are put in one order for all sets, by how often the shingles of their hash bucket occur, then by
hash; any order is right, and rare ones first keeps what many texts share out of the prefixes. Two sets that link share a shingle within
their prefixes (a set of n shingles that must share o keeps n - o + 1), and sets of equal prefix and size form one group, so that prefixes meet as groups.
Pairs of groups are filtered by size and by the place of the shingle they share, then expanded to their sets. Sets have sketches, parities of the number of their
shingles in each of some buckets: sets that differ in d shingles differ in d parities at most, so most pairs are told apart by their sketches; what is left is compared shingle by shingle.

Only components are asked for, so pairs that are connected already need no comparison. The first step compares each group with one pivot of
every shingle it shares, the group that has fewest rarer shingles and so is nearest to what the others are copies of, and each set with the first of its group: as many
pairs as there are places in prefixes. The second compares what is left,
all pairs of sets of different components whose groups share a shingle and pass the filters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.base import by_bitmap, drop, every, materialize, named, only_rows, passing, row_keys, same_row
from loomlog.llm.components import components
from loomlog.llm.rolling import RunHasher

#: Two sets link if SHARE[1] * shared >= SHARE[0] * all.
SHARE = (90, 100)
#: Counters of shingles by hash bucket; their number bounds what goes to the driver and out to the tasks.
BUCKET_BITS = 18
_SLICE_BITS = 12
#: Keys of the texts to compare are broadcast up to so many rows, else joined by shuffle.
MOST_BROADCAST = 400_000


def shingles(text: str | None, width: int, hasher: RunHasher) -> np.ndarray:
    """The distinct hashes of a text's word shingles in ascending order; of fewer words than ``width``, that of all; none without a word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hasher.load(words)
    n = len(words)
    return np.unique(hasher.of(np.arange(n - width + 1), width) if n >= width else hasher.of(np.zeros(1, np.int64), n))


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities by the last bits of the hash, about half as many as the set has shingles, a power of two."""
    bits = max(64, 1 << (len(own) // 2).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _count(docs: DataFrame, width: int, id_type: str) -> DataFrame:
    """A row a document: ``_id, _key, n, sig``; and rows ``slice, counts``: what each task has counted of the buckets."""
    schema = f"_id {id_type}, _key long, n long, sig binary, slice int, counts array<long>"

    def run(batches):
        hasher, seen, id_kind = RunHasher(), np.zeros(1 << BUCKET_BITS, np.int64), None
        for batch in batches:
            n, sig, id_kind = [], [], batch.column(0).type
            for text in batch.column(2):
                own = shingles(text.as_py(), width, hasher)
                n.append(len(own))
                sig.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                np.add.at(seen, (own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
            rows = len(n)
            nothing = [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), *nothing], names=["_id", "_key", "n", "sig", "slice", "counts"])
        if seen.any():
            parts = seen.reshape(-1, 1 << _SLICE_BITS)
            k = len(parts)
            empty = [pa.nulls(k, t) for t in (id_kind, pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(k), pa.int32()), pa.array(list(parts), pa.list_(pa.int64()))], names=["_id", "_key", "n", "sig", "slice", "counts"])

    return docs.mapInArrow(run, schema)


def _bucket_counts(counted: DataFrame) -> np.ndarray:
    """The summed counters, ``1 << BUCKET_BITS`` numbers whatever the input."""
    parts = counted.where("slice is not null").select("slice", F.posexplode("counts").alias("at", "c"))
    sums = parts.groupBy("slice", "at").agg(F.sum("c").alias("c")).where("c > 0").toPandas()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[(sums["slice"].to_numpy(np.int64) << _SLICE_BITS) + sums["at"].to_numpy(np.int64)] = sums["c"].to_numpy(np.int64)
    return out


def _prefixes(docs: DataFrame, counts: np.ndarray, width: int, share: tuple[int, int], id_type: str) -> DataFrame:
    """``_id, _key, n, sig, gkey, prefix, sketch`` of the texts whose sets can link with another set."""
    num, den = share
    least, known = -(-num // (den - num)) if den > num else 1 << 62, docs.sparkSession.sparkContext.broadcast(counts)
    schema = f"_id {id_type}, _key long, n long, sig binary, gkey binary, prefix array<long>, sketch array<long>"

    def run(batches):
        hasher, often = RunHasher(), known.value
        for batch in batches:
            at, n, sig, gkey, prefix, short = [], [], [], [], [], []
            for k, text in enumerate(batch.column(2)):
                own = shingles(text.as_py(), width, hasher)
                size = len(own)
                if size < least:
                    continue
                order = np.lexsort((own, often[(own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
                first = own[order[: size - -(-num * size // den) + 1]].view(np.int64)
                at.append(k)
                n.append(size)
                sig.append(xxhash.xxh3_128_digest(own.tobytes()))
                gkey.append(xxhash.xxh3_128_digest(size.to_bytes(8, "little") + first.tobytes()))
                prefix.append(first)
                short.append(sketch(own))
            keep = pa.array(at, pa.int64())
            columns = [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(gkey, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (prefix, short))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "n", "sig", "gkey", "prefix", "sketch"])

    return docs.mapInArrow(run, schema)


def _whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """``sid, own``: the sets of texts given as ``sid, _text``."""

    def run(batches):
        hasher = RunHasher()
        for batch in batches:
            own = [shingles(t.as_py(), width, hasher).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["sid", "own"])

    return texts.mapInArrow(run, "sid long, own array<long>")


def _need(a, b, share: tuple[int, int]):
    """The least number of shingles that linked sets of these sizes share."""
    num, den = share
    return F.ceil(num * (a + b) / (num + den) - 1e-9)


def _places(groups: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``token, band, host, gid, n, pos``: the places of shingles that several groups have in their prefixes.

    Sizes are cut into bands by which linked sizes lie in one band or in neighbours; a group is host in its own and guest in the next.
    """
    places = groups.select(F.posexplode("prefix").alias("pos", "token"), "gid", "n")
    shared = places.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    shared = materialize(shared, "jaccard-shared")  # a bare exchange on either side lets a frequent shingle be split
    band = F.floor(F.log("n") / (math.log(share[1] / share[0]) * (1 + 1e-9))).cast("int")
    met = places.join(shared, "token").select("token", "pos", "gid", "n", band.alias("own"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up"))
    return materialize(met.select("token", (F.col("own") + F.col("up")).alias("band"), (F.col("up") == 0).alias("host"), "gid", "n", "pos"), "jaccard-places")


def _fits(share: tuple[int, int]):
    """Whether places ``a`` and ``b`` of one shingle can be the first that two linked sets share."""
    need = _need(F.col("a.n"), F.col("b.n"), share)
    return (F.least("a.n", "b.n") * share[1] >= F.greatest("a.n", "b.n") * share[0]) & (F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= need)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, share: tuple[int, int], name: str) -> DataFrame:
    """The pairs ``a, b`` of sets that link. Pairs are filtered by sketches; only the texts of those left are read into sets."""
    one, other = (classes.select(F.col("sid").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}s")) for x in "ab")
    half = lambda c, k: F.slice(c, 1 + k * (F.size(c) / 2).cast("int"), (F.size(c) / 2).cast("int"))
    folded = lambda c, d: F.when(F.size(c) > F.size(d), F.zip_with(half(c, 0), half(c, 1), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(folded("as", "bs"), folded("bs", "as"), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, k: total + k)
    close = differ <= F.col("an") + F.col("bn") - 2 * _need(F.col("an"), F.col("bn"), share)
    pairs = materialize(pairs.distinct().join(one, "a").join(other, "b").where(close).select("a", "b"), f"{name}-pairs")
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    keys = materialize(classes.select("sid", "_id", "_key").join(wanted, "sid", "left_semi"), f"{name}-keys")
    found = same_row(docs, F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, "inner")
    sets = materialize(_whole_sets(found.select("sid", "_text").dropDuplicates(["sid"]), width), f"{name}-sets")
    one = sets.select(F.col("sid").alias("a"), F.col("own").alias("_x"))
    other = sets.select(F.col("sid").alias("b"), F.col("own").alias("_y"))
    both = pairs.join(one, "a").join(other, "b")
    shared, all_ = F.size(F.array_intersect("_x", "_y")), F.size("_x") + F.size("_y")
    out = materialize(both.where(shared * (share[0] + share[1]) >= share[0] * all_).select("a", "b"), f"{name}-links")
    drop(pairs, keys, sets)
    return out


def _linked(docs: DataFrame, classes: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """``sid, root`` of all sets that link with another (``classes``: a row a set)."""
    groups = materialize(classes.groupBy("gkey").agg(F.min("sid").alias("gid"), F.count("*").alias("m")), "jaccard-groups")
    inside = classes.select("sid", "gkey").join(groups, "gkey").select("sid", "gid", "m")
    # the first set of each group stands for it; prefixes are read where they lie
    others = materialize(inside.where("sid <> gid").select("sid"), "jaccard-inner")
    doubtful, sure = by_bitmap(classes.select("sid", "n", "prefix"), others, "sid")
    leading = sure.union(doubtful.join(others, "sid", "left_anti")).withColumnRenamed("sid", "gid")
    places = _places(leading, share)
    alive = inside.join(places.select("gid").distinct(), "gid", "left_semi").union(inside.where("m > 1")).distinct()
    alive = materialize(alive, "jaccard-alive")

    pivots = materialize(places.where("host").groupBy("token", "band").agg(F.min(F.struct("pos", "gid", "n")).alias("p")).select("token", "band", "p.*"), "jaccard-pivots")
    star = places.alias("a").join(pivots.alias("b"), ["token", "band"]).where((F.col("a.gid") != F.col("b.gid")) & _fits(share))
    star = star.select(F.least("a.gid", "b.gid").alias("a"), F.greatest("a.gid", "b.gid").alias("b"))
    star = star.union(alive.where("sid <> gid").select(F.col("gid").alias("a"), F.col("sid").alias("b")))
    first = _verified(star, docs, classes, width, share, "jaccard-star")
    rooted = components(first, "jaccard-first")

    known = alive.join(rooted, alive["sid"] == rooted["node"], "left").select("sid", "gid", F.coalesce("root", "sid").alias("root"))
    known = materialize(known, "jaccard-known")
    span = known.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_ = places.join(span, "gid")
    # a shingle all of whose groups are one component needs no more comparisons
    split = open_.groupBy("token", "band").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("token", "band")
    left = materialize(open_.join(materialize(split, "jaccard-split"), ["token", "band"]), "jaccard-left")
    apart = (F.col("a.low") != F.col("b.low")) | (F.col("a.high") != F.col("b.high")) | (F.col("a.low") != F.col("a.high"))
    met = left.where("host").alias("a").join(left.alias("b"), ["token", "band"])
    met = met.where((F.col("a.gid") != F.col("b.gid")) & (~F.col("b.host") | (F.col("a.gid") < F.col("b.gid"))) & apart & _fits(share))
    pairs = met.select(F.least("a.gid", "b.gid").alias("g"), F.greatest("a.gid", "b.gid").alias("h")).distinct()
    pairs = materialize(pairs.union(span.where("low <> high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))), "jaccard-met")
    one = known.select(F.col("gid").alias("g"), F.col("sid").alias("a"), F.col("root").alias("ra"))
    other = known.select(F.col("gid").alias("h"), F.col("sid").alias("b"), F.col("root").alias("rb"))
    expanded = pairs.join(one, "g").join(other, "h").where("ra <> rb and (g <> h or a < b)").select("a", "b")
    second = _verified(expanded, docs, classes, width, share, "jaccard-rest")
    edges = rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second)
    final = components(edges, "jaccard-final")
    drop(groups, places, alive, pivots, left, pairs, first, second)
    return final.select(F.col("node").alias("sid"), "root").union(final.select(F.col("root").alias("sid"), "root").distinct())


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, share: tuple[int, int] = SHARE) -> DataFrame:
    """Returns the id column, n_shingles (size of the set), component_id (smallest id reachable over links, itself included), ``_key``, the
    hash of id and text that tells rows of one id apart, and ``_root``, a name of the component (null for an empty set).

    Texts are lower-cased (A-Z) and cut at the six white-space bytes; sets compare by 64-bit hashes of shingles. A text of fewer words than ``width`` is
    one shingle; null texts and those without a word have an empty set, link with nothing, and are their own component. Very long texts count whole.
    Null ids stay null and count for no component's smallest id; repeated rows each have their row; other columns are not looked at;
    no rows give no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(*row_keys(id_col, text_col), named(text_col).alias("_text"))
    counted = materialize(_count(texts, width, id_type), "jaccard-counted")
    rows = counted.where("slice is null").select("_id", "_key", "n", "sig")
    prefixed = _prefixes(texts, _bucket_counts(counted), width, share, id_type).dropDuplicates(["sig"])
    classes = materialize(prefixed.withColumn("sid", F.monotonically_increasing_id()), "jaccard-classes")  # written with its numbers

    linked = classes.select("sig", "sid").join(_linked(texts, classes, width, share), "sid").select("sig", "root")
    firsts = rows.where("sig is not null").groupBy("sig").agg(F.min("_id").alias("_first"))
    known = materialize(firsts.join(linked, "sig", "left"), "jaccard-classes-found")
    least = known.where("root is not null").groupBy("root").agg(F.min("_first").alias("_least"))
    named_ = materialize(known.join(least, "root", "left").select(F.col("sig").alias("_sig"), F.when(F.col("root").isNull(), F.col("_first")).otherwise(F.col("_least")).alias("_component"), F.coalesce(F.col("root").cast("string"), F.hex("sig")).alias("_root")), "jaccard-components")
    out = rows.join(named_, rows["sig"] == named_["_sig"], "left")
    component = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("_component"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), "_key", "_root")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, one of each component: the one of the smallest id, null ids last; repeated rows once, and rows of empty sets all."""
    with passing() as keep:  # tables that led to the components go before the rows are read
        found = keep(materialize(join(docs, id_col=id_col, text_col=text_col, **how).select(named(id_col).alias("_id"), "_key", "_root"), "jaccard-found"))
    one = found.where("_root is not null").groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_key")).alias("_one")).select("_one._id", "_one._key")
    kept = materialize(one.union(found.where("_root is null").select("_id", "_key").distinct()), "jaccard-kept")
    rest = materialize(same_row(found.select("_id", "_key"), kept, "left_anti"), "jaccard-others")
    rows = only_rows(docs.select(*row_keys(id_col, text_col), every(docs).alias("_row")), kept, rest)
    if not found.where("_root is not null").groupBy("_id", "_key").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["_id", "_key"])
    return rows.select("_row.*")
