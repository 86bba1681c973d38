"""Quality classifier from positives and unlabelled text, by non-negative unbiased risk (Kiryo et al., 2017).

Each document is a cell: its figures in fixed bins. There are at most ``prod(bins)`` cells (78,125) whatever the corpus,
so Spark counts all trusted positives and all unlabelled documents per cell, and the risk, an average over cells, is
minimised on these counts: no document is left out and none is sent to the driver. Labels of bad documents are
never used. The class prior is estimated first, by the best bin of a classifier of positives against unlabelled
text (Garg et al., 2021): the least ratio of their shares above a threshold bounds the share of positives.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm import logistic
from loomlog.llm.base import SPACES, length_without, let, lines_of, materialize, named, words_of
from loomlog.llm.quality_rules import SYMBOLS, UPPER

#: Cuts between the bins of each figure; shares in thousandths.
CUTS = {
    "symbols": (1, 20, 100, 250),
    "upper": (30, 60, 150, 400),
    "repeated_lines": (1, 150, 300, 600),
    "stutter": (15, 50, 200, 500),
    "distinct": (100, 300, 500, 620),
    "words": (20, 50, 100, 1000),
    "word_length": (4200, 5800, 6500, 7500),
}
_WIDE = max(len(c) for c in CUTS.values()) + 1


def held_out(id_col: str, folds: int = 3, fold_no: int = 1) -> Column:
    return F.coalesce(F.crc32(named(id_col).cast("string")) % folds == fold_no, F.lit(False))


def cells(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, held_out, cell``: the figures' bins as digits of a number."""
    text = F.coalesce(named(text_col), F.lit(""))
    out = docs.select(named(id_col).alias("_id"), held_out(id_col).alias("held_out"), text.alias("_text"), words_of(text).alias("_words"))
    out = out.withColumn("_lines", lines_of(F.col("_text")))
    without = lambda kind: length_without(F.col("_text"), kind)
    out = out.select(
        "_id", "held_out", without(SPACES).alias("chars"), F.length("_text").alias("all"), without(SYMBOLS).alias("plain"), without(UPPER).alias("low"),
        F.size("_lines").alias("lines"), F.size(F.array_distinct("_lines")).alias("own_lines"), F.size("_words").alias("words"), F.size(F.array_distinct("_words")).alias("own_words"),
        let(F.col("_words"), lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))).alias("same"),
    )
    share = {
        "symbols": "1000L * (all - plain) div greatest(chars, 1)", "upper": "1000L * (all - low) div greatest(chars, 1)", "repeated_lines": "1000L * (lines - own_lines) div greatest(lines, 1)",
        "stutter": "1000L * same div greatest(words, 1)", "distinct": "1000L * own_words div greatest(words, 1)", "words": "words", "word_length": "1000L * chars div greatest(words, 1)",
    }
    cell = F.lit(0)
    for name, cuts in CUTS.items():
        digit = F.lit(0)
        for cut in cuts:
            digit = digit + (F.expr(share[name]) >= cut).cast("int")
        cell = cell * _WIDE + digit
    return out.select("_id", "held_out", cell.alias("cell"))


def design(codes: np.ndarray) -> np.ndarray:
    """One column per figure and bin."""
    parts = []
    for k in reversed(range(len(CUTS))):
        digit = codes // _WIDE ** (len(CUTS) - 1 - k) % _WIDE
        parts.append(digit[:, None] == np.arange(_WIDE))
    return np.hstack(parts[::-1]).astype(float)


def class_prior(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in the unlabelled text: the least upper bound over the thresholds of a classifier of the two."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    w = _weighted_logistic(x, positive / n_p, unlabelled / n_u)
    order = np.argsort(-(x @ w), kind="stable")
    p, u = np.cumsum(positive[order]) / n_p, np.cumsum(unlabelled[order]) / n_u
    slack = math.sqrt(math.log(4 / delta) / 2) * (1 / math.sqrt(n_p) + 1 / math.sqrt(n_u))
    best = int(np.argmin(np.where(p > 0.1, (u + slack) / np.maximum(p, 1e-12), np.inf)))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def _weighted_logistic(x: np.ndarray, one: np.ndarray, zero: np.ndarray, ridge: float = 1e-4, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = logistic.sigmoid(x @ w)
        both = one + zero
        step = np.linalg.solve((x * (both * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (one * (1 - p) - zero * p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def non_negative_risk(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = 1e-3, steps: int = 3000, rate: float = 0.05) -> np.ndarray:
    """Weights that minimise prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)), with logistic loss, by Adam on all cells."""
    if not positive.sum() or not unlabelled.sum():
        return np.zeros(x.shape[1])
    p, u = positive / positive.sum(), unlabelled / unlabelled.sum()
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        z = x @ w
        up = logistic.sigmoid(z)
        as_negative = (u - prior * p) @ np.logaddexp(0, z)
        negative = x.T @ ((u - prior * p) * up)
        # a negative part below zero is overfit and is walked back (the published rule)
        slope = prior * x.T @ (p * (up - 1)) + negative if as_negative >= 0 else -negative
        slope = slope + ridge * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - rate / (1 + 3 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cutoff: float = 0.5) -> DataFrame:
    """Returns the id, held_out, score and predicted for every row.

    Trusted positives are training-fold rows whose labels are all 1; unlabelled are the training-fold rows without a label.
    Null and empty texts are a cell like any other; rows with a null id are scored, not held out and taken as unlabelled; repeated
    rows count and score each for itself; without positives or unlabelled rows every score is one half; very long texts
    are scored whole; other columns are not looked at; no rows give no rows.
    """
    every = materialize(cells(docs, id_col, text_col), "cells")
    known = labels.where(named(label_col).isNotNull() & named(id_col).isNotNull()).groupBy(named(id_col).alias("_lid")).agg(F.min(named(label_col)).cast("int").alias("_y"))
    train = every.where("not held_out")
    counted = train.join(known, F.col("_id") == F.col("_lid"), "left").groupBy("cell").agg(
        F.count_if(F.col("_y") == 1).alias("positive"), F.count_if(F.col("_y").isNull()).alias("unlabelled")
    )
    rows = sorted(tuple(r) for r in counted.collect())  # at most one row a cell
    codes, positive, unlabelled = (np.array([r[k] for r in rows], float) for k in range(3))
    x = design(codes.astype(np.int64))
    w = non_negative_risk(x, positive, unlabelled, class_prior(x, positive, unlabelled))
    total = F.lit(0.0)
    for k in range(len(CUTS)):
        bins = F.array(*[F.lit(float(v)) for v in w[k * _WIDE : (k + 1) * _WIDE]])
        total = total + F.get(bins, F.expr(f"cast(cell div {_WIDE ** (len(CUTS) - 1 - k)} as int) % {_WIDE}"))
    out = every.select(F.col("_id").alias(id_col), "held_out", (1 / (1 + F.exp(-total))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
