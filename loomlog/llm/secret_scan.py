"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Spans are found with Java regular expressions: the pieces between matches give the offsets. Every candidate's
SHA-256 is counted over the corpus by distinct owners and repositories. A value that many owners or many repositories hold is a copied example;
one that few of both hold is owner-specific. The patterns of the base set always report; long mixed tokens, which
would report every identifier, are added only where they are owner-specific.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.base import every, let, materialize, named, row_keys, same_row


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed values of the contract: the kinds in order, their patterns and least lengths.
KEYWORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
PATTERNS = {
    "assign": rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",  # runs are maximal, so this is [0-9a-f]+ of 24 or more
    "owned": "[A-Za-z0-9_+/-]{20,}",
}
KINDS = tuple(PATTERNS)
LEAST = {"assign": 6, "access": 20}
MARK = "[SECRET]"
_BLOCK = 256


def _value(kind: str, match: Column) -> Column:
    return F.regexp_extract(match, PATTERNS["assign"], 2) if kind == "assign" else match


def _passes(kind: str, match: Column) -> Column:
    if kind in LEAST:
        return F.length(_value(kind, match)) >= LEAST[kind]
    if kind == "owned":
        return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _before(numbers: Column, body) -> Column:
    """``body(f)``, where f(i) is the sum of the first i numbers, summed by blocks so that long arrays stay fast."""

    def with_blocks(ns: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(ns) / _BLOCK).cast("int")), lambda b: _total(F.slice(ns, b * _BLOCK + 1, F.lit(_BLOCK))))

        def with_sums(bs: Column) -> Column:
            sums = F.transform(bs, lambda _, b: _total(F.slice(bs, F.lit(1), b)))
            return let(sums, lambda s: body(lambda i: F.get(s, F.floor(i / _BLOCK).cast("int")) + _total(F.slice(ns, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))

        return let(blocks, with_sums)

    return let(numbers, with_blocks)


_SPAN = "array<struct<start:int,kind:int,end:int,hash:string>>"


def spans_of(kind: str, text: Column) -> Column:
    """Leftmost non-overlapping matches that pass, as (start, kind, end, hash) in code points."""

    def place(ms: Column) -> Column:
        pieces = F.transform(F.split(text, PATTERNS[kind], -1), lambda p: F.length(p))

        def with_pieces(ps: Column) -> Column:
            both = F.transform(ms, lambda m, i: F.get(ps, i) + F.length(m))

            def put(sum_before) -> Column:
                def span(m: Column, i: Column) -> Column:
                    start = sum_before(i) + F.get(ps, i)
                    digest = F.when(_passes(kind, m), F.sha2(_value(kind, m), 256))
                    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(m)).alias("end"), digest.alias("hash"))

                return F.filter(F.transform(ms, span), lambda s: s["hash"].isNotNull())

            return _before(both, put)

        return F.when(F.size(ms) == 0, F.array().cast(_SPAN)).otherwise(let(pieces, with_pieces).cast(_SPAN))

    return let(_matches(kind, text), place)


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",), repository_cols: tuple[str, ...] = ("source", "lang"),
    most_owners: int = 2, most_repositories: int = 4, keep_texts: bool = False,
) -> DataFrame:
    """The secrets of every row.

    A value is owner-specific if at most ``most_owners`` owners and ``most_repositories`` repositories hold it. ``documents`` names neither, so by default the source
    stands for the owner and source and language for the repository, which is coarse; name the columns where there are better ones.

    Returns ``_row`` (a struct: all columns of docs if ``keep_texts``, else the id), n_assign, n_access, n_hex, base_sha256, spans, n_owner_specific and
    n_widely_copied (of all candidates), and ``_marked`` (the spans as structs). Null texts are empty; null owner columns are one owner; null ids stay null; repeated
    rows each have their row and count once towards an owner; very long texts are scanned whole; no rows give no rows; other columns of docs are only carried.
    """
    row = every(docs) if keep_texts else F.struct(named(id_col))
    joined = lambda cols: F.concat_ws("\x00", *[F.coalesce(named(c).cast("string"), F.lit("")) for c in cols])
    owner, repository, text = joined(owner_cols), joined(repository_cols), F.coalesce(named(text_col), F.lit(""))
    rows = docs.select(row.alias("_row"), *row_keys(id_col, text_col), owner.alias("_owner"), repository.alias("_repository"), text.alias("_text"))
    rows = rows.withColumns({f"_{k}": spans_of(k, F.col("_text")) for k in KINDS}).drop("_text")
    base = F.concat(*[F.col(f"_{k}") for k in KINDS[:3]])
    apart = lambda b: F.filter("_owned", lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (x["end"] > s["start"])))
    rows = rows.select("_row", "_id", "_key", "_owner", "_repository", *[f"_{k}" for k in KINDS[:3]], base.alias("_base"), let(base, apart).alias("_more"))
    found = materialize(rows, "secrets")

    each = found.where("size(_base) + size(_more) > 0").select("_id", "_key", "_owner", "_repository", F.explode(F.concat("_base", "_more")).alias("_s"))
    holders = each.select(F.col("_s.hash").alias("_hash"), "_owner", "_repository").distinct()
    holders = holders.groupBy("_hash", "_owner").agg(F.count("*").alias("_n")).groupBy("_hash").agg(F.count("*").alias("_owners"), F.sum("_n").alias("_repositories"))
    holders = materialize(holders, "secret-holders")  # a bare exchange on either side lets a hot value be split
    known = each.select("_id", "_key", "_s").join(holders, F.col("_s.hash") == F.col("_hash"))
    by_row = known.groupBy("_key", "_id").agg(F.collect_set(F.struct("_s", ((F.col("_owners") <= most_owners) & (F.col("_repositories") <= most_repositories)).alias("live"))).alias("_known"))

    hit = same_row(found.where("size(_base) + size(_more) > 0"), by_row, "left")
    out = found.where("size(_base) + size(_more) = 0").withColumn("_known", F.array().cast("array<struct<_s:struct<start:int,kind:int,end:int,hash:string>,live:boolean>>")).unionByName(hit)
    added = F.transform(F.filter("_known", lambda k: (k["_s"]["kind"] == 3) & k["live"]), lambda k: k["_s"])
    n = lambda c: F.size(c).cast("long")
    return out.select(
        "_row", n("_assign").alias("n_assign"), n("_access").alias("n_access"), n("_hex").alias("n_hex"),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.concat("_base", added)).alias("spans"),
        n(F.filter("_known", lambda k: k["live"])).alias("n_owner_specific"), n(F.filter("_known", lambda k: ~k["live"])).alias("n_widely_copied"),
        F.concat("_base", added).alias("_marked"),
    )


def _apart(spans: Column) -> Column:
    """The spans' places in order, those that overlap as one."""
    one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))

    def put(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"])
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), one(last["start"], F.greatest(last["end"], s["end"])))).otherwise(F.concat(done, one(s["start"], s["end"])))

    return F.aggregate(F.sort_array(spans), F.array().cast("array<struct<start:int,end:int>>"), put)


def redacted(text: Column, spans: Column) -> Column:
    """The text with MARK in place of each span. Spans go by blocks, so that a long text is not walked through for each."""

    def rebuilt(all_spans: Column) -> Column:
        def block(b: Column) -> Column:
            begin = F.when(b == 0, 0).otherwise(F.get(all_spans, b * _BLOCK - 1)["end"])

            def within(own: Column) -> Column:
                piece = F.substring(text, begin + 1, F.element_at(own, -1)["end"] - begin)
                before = lambda i: F.when(i == 0, begin).otherwise(F.get(own, i - 1)["end"])
                return let(piece, lambda p: F.array_join(F.transform(own, lambda s, i: F.concat(F.substring(p, before(i) - begin + 1, s["start"] - before(i)), F.lit(MARK))), ""))

            return let(F.slice(all_spans, b * _BLOCK + 1, F.lit(_BLOCK)), within)

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_spans) - 1) / _BLOCK).cast("int")), block)
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.element_at(all_spans, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(_apart(spans), rebuilt))


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars", **how) -> DataFrame:
    """The rows of docs with MARK in place of the spans that ``scan`` reports, and the lengths of those texts set anew; null and clean texts stay as they are."""
    found = scan(docs, text_col=text_col, keep_texts=True, **how)
    text = F.col("_row").getField(text_col)
    hit = F.size("_marked") > 0
    out = found.select("_row", hit.alias("_hit"), F.when(hit, redacted(text, F.col("_marked"))).otherwise(text).alias("_clean"))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("_clean").alias(c))
        elif c == length_col:
            columns.append(F.when(F.col("_hit"), F.length("_clean").cast(docs.schema[c].dataType)).otherwise(F.col("_row").getField(c)).alias(c))
        else:
            columns.append(F.col("_row").getField(c).alias(c))
    return out.select(*columns)
