"""Conversation structure repair by Knuth's lightest-derivation agenda.

An item [i, q] says that the first i rows are repaired and that the roles so far leave the grammar ``(s?(ua)+)?`` in state q. Deductions keep,
rerole or delete the next row or insert one; each is a superior function of the weight (cost, audit): it adds to the cost and to the end
of the audit, so weights never fall and keep their order. (Of two audits of the same rows and cost neither begins the other: what the longer has
beyond would be inserted rows, which cost.) Items are popped by weight, and the first goal item popped is the lightest repair.

Rows are put in order once and cut into blocks, so a long conversation is not one task: a block's items [p, q] are found for every state p it may begin
in, and items of neighbouring blocks combine by the same agenda, a few hundred blocks at a time, until one is left. Texts take no part in that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.base import SPACES, drop, materialize, named

#: Costs of an edit by its initial, and what a truncated row costs besides if it stays.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: States of the grammar: nothing yet, after a system row, after a user's, after a pair. The last rows may leave the first or the last.
BEGIN, SYSTEM, USER, PAIR = range(4)
_NEXT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
#: The role that an inserted or reroled row has in a state.
_WANTED = {BEGIN: "user", SYSTEM: "user", USER: "assistant", PAIR: "user"}
#: Rows of a block as a power of two, and blocks that combine at once.
_BLOCK_BITS, _FAN = 8, 256

Weight = tuple[int, str]


def agenda(n: int, start: int, deductions: Callable[[int, int], Iterable[tuple[int, str, int, int]]]) -> dict[int, Weight]:
    """The lightest weight of each item [n, q] that follows from [0, start]: items are popped by weight, and an item's first pop is final."""
    final: dict[tuple[int, int], Weight] = {}
    heap = [(0, "", 0, start)]
    goals = 0
    while heap and goals < len(_WANTED):
        cost, audit, i, q = heappop(heap)
        if (i, q) in final:
            continue
        final[i, q] = cost, audit
        goals += i == n
        for more, edit, j, r in deductions(i, q):
            if (j, r) not in final:
                heappush(heap, (cost + more, audit + edit, j, r))
    return {q: final[n, q] for q in range(len(_WANTED)) if (n, q) in final}


def _row_deductions(codes: str) -> Callable:
    """Deductions over rows: ``codes`` has the initial of each row's role, ``x`` for any other, upper case if truncated, ``d`` where it must go."""

    def run(i: int, q: int):
        wanted = _NEXT[q, _WANTED[q][0]]
        yield COSTS["I"], "I", i, wanted
        if i < len(codes):
            code = codes[i]
            yield COSTS["D"], "D", i + 1, q
            if code != "d":
                stays = TRUNCATED if code.isupper() else 0
                yield COSTS["R"] + stays, "R", i + 1, wanted
                if (q, code.lower()) in _NEXT:
                    yield COSTS["K"] + stays, "K", i + 1, _NEXT[q, code.lower()]

    return run


@lru_cache(maxsize=20_000)
def block_items(codes: str) -> tuple[tuple[int, int, int, str], ...]:
    """(p, q, cost, audit) of a block of rows for each state before and after it."""
    return tuple((p, q, *w) for p in range(len(_WANTED)) for q, w in agenda(len(codes), p, _row_deductions(codes)).items())


def joined_items(blocks: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """The items of blocks one after another, from their items."""
    if len(blocks) == 1:
        return blocks[0]
    leads = [{p: [x for x in own if x[0] == p] for p in range(len(_WANTED))} for own in blocks]
    step = lambda k, p: [(cost, audit, k + 1, q) for _, q, cost, audit in leads[k][p]] if k < len(leads) else []
    return [(p, q, *w) for p in range(len(_WANTED)) for q, w in agenda(len(leads), p, step).items()]


def _adjacent(a: str, b: str) -> int:
    return a + b not in ("su", "ua", "au")


_ITEMS = "array<struct<p:int,q:int,cost:long,audit:string>>"
_ITEM = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_BLOCK = ("block", "first", "last", "illegal", "items")


def _blocks_out(conv: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), _ITEM)
    items = lambda own: [dict(zip(("p", "q", "cost", "audit"), x, strict=True)) for x in own]
    columns = list(zip(*[(*r[:4], items(r[4])) for r in rows], strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([conv, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["_conv", *_BLOCK])


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for block, codes, initials in zip(*(batch.column(c).to_pylist() for c in ("block", "codes", "initials")), strict=True):
            illegal = sum(map(_adjacent, initials, initials[1:]))
            rows.append((block, initials[0], initials[-1], illegal, block_items("".join(codes))))
        yield _blocks_out(batch.column("_conv"), rows)


def _joined_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for block, own in zip(batch.column("block").to_pylist(), batch.column("own"), strict=True):
            own = own.as_py()
            items = joined_items([[tuple(x.values()) for x in b["items"]] for b in own])
            illegal = sum(b["illegal"] for b in own) + sum(_adjacent(a["last"], b["first"]) for a, b in zip(own, own[1:], strict=False))
            rows.append((block, own[0]["first"], own[-1]["last"], illegal, items))
        yield _blocks_out(batch.column("_conv"), rows)


def ordered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``_conv`` (a struct, so that a null conversation is one), ``_at``, ``turn, role, text``, hashes of role and text, and whether the text is ``blank`` or ``cut``.

    ``_at`` orders all rows: by conversation, turn (nulls first), role and text; it is written with the rows. Null roles and texts are one space.
    """
    role, text = (F.coalesce(named(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    flat = rows.select(F.struct(named(conv_col).alias("id")).alias("_conv"), named(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    flat = flat.withColumns({"_d1": F.xxhash64("role", F.lit(":"), "text"), "_d2": F.xxhash64(F.lit("repair"), "role", F.lit(":"), "text"), "_head": F.substring("text", 1, 64)})
    order = ["_conv", "turn", "role", "_head", "_d1", "_d2"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = flat.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_head").withColumn("_at", F.monotonically_increasing_id())
    cut = ~F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1).isin(".", "!", "?")
    return materialize(dealt.withColumns({"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut": cut}), "repair-rows")  # bounds of ranges are sampled


def faults(rows: DataFrame) -> DataFrame:
    """``_conv, _at, turn, role`` and the first fault of each row, ``blank``, ``duplicate`` or ``truncated``, without the texts; from the output of ``ordered``."""
    told = rows.select("_conv", "_at", "turn", "role", "_d1", "_d2", "blank", "cut")
    first = told.where("not blank").groupBy("_conv", "_d1", "_d2").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = materialize(first, "repair-first")  # a bare exchange on either side lets a row said very often be split
    met = told.join(first, ["_conv", "_d1", "_d2"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))
    return met.select("_conv", "_at", "turn", "role", "blank", duplicate.alias("duplicate"), (F.col("cut") & ~F.col("blank") & ~duplicate).alias("truncated"))


def lightest(rows: DataFrame) -> DataFrame:
    """``_conv, cost, audit, illegal`` of each conversation, from the output of ``faults``."""
    initial = F.substring("role", 1, 1)
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("blank") | F.col("duplicate"), "d").when(F.col("truncated"), F.upper(plain)).otherwise(plain)
    coded = rows.select("_conv", F.shiftright("_at", _BLOCK_BITS).alias("block"), F.struct("_at", code.alias("c"), plain.alias("i")).alias("r"))
    cut = coded.groupBy("_conv", "block").agg(F.sort_array(F.collect_list("r")).alias("r")).select("_conv", "block", F.col("r.c").alias("codes"), F.col("r.i").alias("initials"))
    kind = rows.schema["_conv"].dataType.simpleString()
    schema = f"_conv {kind}, block long, first string, last string, illegal long, items {_ITEMS}"
    blocks = materialize(cut.mapInArrow(_row_blocks, schema), "repair-blocks")
    numbered = _numbered(blocks)
    while not numbered.groupBy("_conv").count().where("count > 1").isEmpty():
        own = F.sort_array(F.collect_list(F.struct(*_BLOCK))).alias("own")
        joined = numbered.withColumn("_group", F.floor(F.col("block") / _FAN)).groupBy("_conv", F.col("_group")).agg(own)
        before, numbered = numbered, materialize(joined.withColumnRenamed("_group", "block").mapInArrow(_joined_blocks, schema), "repair-joined")
        drop(before)
    goal = F.filter("items", lambda x: (x["p"] == BEGIN) & x["q"].isin(BEGIN, PAIR))
    best = F.array_min(F.transform(goal, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
    return numbered.select("_conv", best.alias("_best"), "illegal").select("_conv", "_best.cost", "_best.audit", "illegal")


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks counted from 0 within their conversation. Those of one file part lie without gaps, so a row a conversation and part tells where they begin."""
    part = F.shiftright("block", 33 - _BLOCK_BITS)
    runs = blocks.groupBy("_conv", part.alias("_part")).agg(F.min("block").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_conv", "_part", (F.col("_low") - F.coalesce(before, F.lit(0))).alias("_base"))
    out = blocks.withColumn("_part", part).join(runs, ["_conv", "_part"])
    return out.withColumn("block", F.col("block") - F.col("_base")).drop("_part", "_base").select("_conv", *_BLOCK)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation or None, edit, role, text, turn) over the rows of ``_led``: a conversation's head, then its rows and what is inserted between them."""
    audit, at, state = "", 0, BEGIN

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = _WANTED[state]
            state, at = _NEXT[state, role[0]], at + 1
            yield None, "I", role, "", None

    for batch in batches:
        for conv, head, turn, role, text in zip(batch.column("_conv"), *(batch.column(c).to_pylist() for c in ("audit", "turn", "role", "text")), strict=True):
            if head is not None:
                audit, at, state = head, 0, BEGIN
                yield conv, "", "", "", None
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    role = _WANTED[state] if edit == "R" else role
                    state = _NEXT[state, role[0]]
                yield None, edit, role, text, turn
            yield from inserted()


def _led(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition; no partition holds a conversation in memory."""
    heads = found.select("_conv", F.lit(-1).cast("long").alias("_at"), "audit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = heads.union(rows.select("_conv", "_at", F.lit(None).cast("string"), "turn", "role", "text"))
    return both.repartition("_conv").sortWithinPartitions("_conv", "_at")


def repaired(rows: DataFrame, found: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The repaired rows: the conversation's id, position (from 0), turn (null where inserted), role, text, edit; deleted rows are left out."""
    kind = rows.schema["_conv"].dataType
    schema = f"_conv {kind.simpleString()}, position long, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string, edit string"

    def run(batches):
        conv, position, out, turn_kind = None, 0, [], None

        def first(source):
            nonlocal turn_kind
            for batch in source:
                turn_kind = batch.schema.field("turn").type
                yield batch

        def flush():
            cols = list(zip(*out, strict=True))
            kinds = (out[0][0].type, pa.int64(), turn_kind, pa.string(), pa.string(), pa.string())
            convs = pa.array([c.as_py() for c in cols[0]], kinds[0])
            return pa.RecordBatch.from_arrays([convs, *[pa.array(c, k) for c, k in zip(cols[1:], kinds[1:], strict=True)]], names=["_conv", "position", "turn", "role", "text", "edit"])

        for head, edit, role, text, turn in _edited(first(batches)):
            if head is not None:
                conv, position = head, 0
            elif edit != "D":
                out.append((conv, position, turn, role, text, edit))
                position += 1
                if len(out) >= 1_000:
                    yield flush()
                    out = []
        if out:
            yield flush()

    return _led(rows, found).mapInArrow(run, schema).select(F.col("_conv.id").alias(conv_col), "position", "turn", "role", "text", "edit")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``_conv, repaired_sha256``: the hash of a conversation's repaired ``role:text``, joined by newlines, fed row by row as they come."""
    schema = f"_conv {rows.schema['_conv'].dataType.simpleString()}, repaired_sha256 string"

    def run(batches):
        conv, hasher, any_ = None, None, False
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([c.as_py() for c, _ in out], out[0][0].type), pa.array([h for _, h in out])], names=["_conv", "repaired_sha256"])
        for head, edit, role, text, _ in _edited(batches):
            if head is not None:
                if conv is not None:
                    out.append((conv, hasher.hexdigest()))
                if len(out) >= 1_000:
                    yield batch()
                    out = []
                conv, hasher, any_ = head, hashlib.sha256(), False
            elif edit != "D":
                hasher.update((("\n" if any_ else "") + f"{role}:{text}").encode())
                any_ = True
        if conv is not None:
            out.append((conv, hasher.hexdigest()))
        if out:
            yield batch()

    return _led(rows, found).mapInArrow(run, schema)


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. A row a conversation: the id column, gaps, blank, duplicate, truncated, illegal (neighbouring roles), cost, audit (the edits' initials), repaired_sha256;
    and the repaired rows (see ``repaired``).

    Null conversations are one conversation; null roles and texts are one space; null turns come first and count for no gap; ties go by role, then by text. An empty
    role has no initial, so its row is never kept as it is. Rows repeated in all columns are duplicates. Very long texts are fed to the hash piece by piece; a
    long conversation is repaired in blocks, but its hash and its repaired rows come from one task that reads it in order. No rows give no rows; other columns are not looked at.
    """
    own = ordered(rows, conv_col, turn_col, role_col, text_col)
    told = materialize(faults(own), "repair-faults")
    found = materialize(lightest(told), "repair-found")
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    counts = told.groupBy("_conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).cast("long").alias("_span"), *sums)
    turns = told.where("turn is not null").select("_conv", "turn").distinct().groupBy("_conv").agg(F.count("*").alias("_turns"))
    out = counts.join(turns, "_conv", "left").join(found, "_conv").join(digests(own, found), "_conv")
    gaps = F.col("_span") - F.coalesce("_turns", F.lit(0))
    out = out.select(F.col("_conv.id").alias(conv_col), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return out, repaired(own, found, conv_col)


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its end marks, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    flat = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(flat("conv_id"), F.lit(":"), flat("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", flat("role").alias("role"), flat("text").alias("text"), kind.alias("_k")).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    again = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), again.alias("_again")).drop("_again")
