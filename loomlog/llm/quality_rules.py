"""Risk-controlled quality rules, in DataFrame functions only.

Every rule rejects a document whose integer metric reaches a cutoff. Cutoffs are not set by hand: on the labelled
holdout, per stratum, the documents labelled good that a cutoff would reject are counted, and the exact binomial
tail gives the p-value of "the false rejection rate is above the allowed one". Cutoffs are tested from the mildest
to the strictest until one fails (fixed-sequence testing, which spends no error on the steps), and the error level
is divided by rules times strata (Bonferroni). The strictest certified cutoff is used; a rule without one rejects
nothing in that stratum. So with probability 1 - delta, in all strata at once, at most ``alpha`` of the good
documents are rejected by the cutoffs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.base import SPACES, every, length_without, let, lines_of, materialize, named, words_of

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
UPPER = "A-Z"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbol_permille", "upper_permille", "dup_line_permille", "repeat_permille", "stutter_permille")
CUTOFFS = (10, 20, 50, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900)
#: The cutoffs, a row a stratum, are broadcast up to this many strata.
MOST_STRATA = 10_000


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words found twice or more; windows compare by their 64-bit hashes."""

    def covered(places: Column) -> Column:  # sorted places of repeated windows
        step = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(tagged, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered))

    def doubled(hashes: Column, by: int) -> Column:  # of runs twice as long; the last ones run over the end
        return let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + by))))

    windows = F.transform(words, lambda w: F.xxhash64(w))
    for by in (1, 2, 4):
        windows = doubled(windows, by)
    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(F.slice(windows, F.lit(1), F.size(words) - WINDOW + 1), count))


def measure(docs: DataFrame, text_col: str, keep: Sequence[Column]) -> DataFrame:
    """``keep``, the base figures and the rules' metrics, all long. Needs no shuffle."""
    text = F.coalesce(named(text_col), F.lit(""))
    out = docs.select(*keep, text.alias("_text"), words_of(text).alias("_words"))
    out = out.withColumn("_lines", lines_of(F.col("_text")))
    whole = {
        "n_words": F.size("_words"),
        "word_chars": length_without(F.col("_text"), SPACES),
        "n_symbols": F.length("_text") - length_without(F.col("_text"), SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "_n_lines": F.size("_lines"),
        "_n_upper": F.length("_text") - length_without(F.col("_text"), UPPER),
        "_n_stutter": let(F.col("_words"), lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))),
    }
    kept = [F.col(c) for c in out.columns if c not in ("_text", "_words", "_lines")]
    out = out.select(*kept, *[v.cast("long").alias(k) for k, v in whole.items()])

    def permille(a: str, b: str) -> Column:
        return F.expr(f"1000 * {a} div greatest({b}, 1)")

    rules = [permille("n_symbols", "word_chars"), permille("_n_upper", "word_chars"), permille("n_dup_lines", "_n_lines"), permille("n_repeat_words", "n_words"), permille("_n_stutter", "n_words")]
    return out.withColumns(dict(zip(RULES, rules, strict=True))).drop("_n_lines", "_n_upper", "_n_stutter")


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed in logarithms; 1 where k is no less than the mean."""
    odds = math.log(rate / (1 - rate))
    start = F.struct((n * math.log(1 - rate)).alias("t"), F.lit(0.0).alias("s"))
    step = lambda a, j: F.struct((a["t"] + F.log((n - j) / (j + 1)) + odds).alias("t"), (a["s"] + F.exp(a["t"])).alias("s"))
    return F.when(k >= n * rate, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda a: a["s"]))


def certified(figures: DataFrame, good_ids: DataFrame, stratum: str, alpha: float, delta: float, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """``_stratum`` and per rule the strictest certified cutoff, or null.

    ``figures`` has _id, ``stratum`` and the metrics; ``good_ids`` has _id, once each.
    """
    per_rule = alpha / len(RULES)
    holdout = figures.join(good_ids, "_id").groupBy(F.col(stratum).alias("_stratum"))
    rejected = {f"{r}_{c}": F.sum((F.col(r) >= c).cast("long")).alias(f"{r}_{c}") for r in RULES for c in cutoffs}
    counts = materialize(holdout.agg(F.count("*").alias("_n"), *rejected.values()), "quality-holdout")
    level = delta / (len(RULES) * max(1, counts.count()))
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).cast("long").alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r in RULES for c in cutoffs])
    rows = counts.select("_stratum", "_n", F.inline(tests)).withColumn("passes", binomial_tail(F.col("_n"), F.col("k"), per_rule) <= level)
    milder = Window.partitionBy("_stratum", "rule").orderBy(F.desc("cutoff"))
    unbroken = rows.withColumn("passes", F.min("passes").over(milder)).where("passes")
    return unbroken.groupBy("_stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])


def judge(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = 0.05, delta: float = 0.05,
    keep_texts: bool = False,
) -> DataFrame:
    """``_row`` (a struct: all columns of docs if ``keep_texts``, else the id), the base figures, metrics, base_failed, kept.

    ``labels`` has the id and ``quality``; an id counts as good if no label of it is null or 0. Null or empty texts
    have figures 0 and fail the base rules for want of words; a null stratum is a stratum of its own; rows with a
    null id are judged but never in the holdout; repeated rows are each judged; an empty holdout certifies
    nothing; very long texts are judged whole; no rows give no rows. Other columns of docs, whatever their names, are only carried.
    """
    row = every(docs) if keep_texts else F.struct(named(id_col))
    keep = [row.alias("_row"), named(id_col).alias("_id"), F.coalesce(named(stratum_col).cast("string"), F.lit("")).alias("_lang")]
    figures = materialize(measure(docs, text_col, keep), "quality-figures")
    good = labels.where(named(id_col).isNotNull()).groupBy(named(id_col).alias("_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("_q")).where("_q = 1").select("_id")
    cuts = materialize(certified(figures.drop("_row"), good, "_lang", alpha, delta), "quality-cutoffs")
    small = F.broadcast(cuts) if cuts.count() <= MOST_STRATA else cuts
    out = figures.join(small, figures["_lang"] == small["_stratum"], "left")
    reject = F.lit(False)
    for r in RULES:
        reject = reject | F.coalesce(F.col(r) >= F.col(f"_cut_{r}"), F.lit(False))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("_row", *BASE, *RULES, base_failed.alias("base_failed"), (~base_failed & ~reject).alias("kept"))
