"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Texts are lower-cased; accents go, full-width and look-alike letters, and digits and signs that stand for letters, are folded; all else that is no letter
parts words. The lexicon holds word beginnings with weights. It is learned: over a bounded sample of labelled training
documents, counts of documents with and without the label give each beginning its log-odds. A match counts at
the start of a word, the longest term there, unless an exception phrase covers it. The sum of weights, also in
proportion to the length, is calibrated to a probability on the same sample.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm import logistic
from loomlog.llm.base import materialize, named

#: Letters of other scripts that look like Latin ones, in pairs.
HOMOGLYPHS = "аaвbеeкkмmнhоoрpсcтtуyхxіiјjѕsԁdԛqԝwһhӏlαaβbεeηnιiκkνvοoρpτtυuχxωw"
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = {"@": "a", "$": "s"}
#: Phrases in which a term means no harm.
EXCEPTIONS = ("trash can", "trash bin", "pond scum", "clown fish", "class clown", "loser bracket", "losers bracket", "idiot proof", "idiot light", "stupid simple")
#: At most so many labelled rows are learned from; all documents are scored.
MOST_TRAINING_ROWS = 20_000

#: The marks that make up accents, and characters that show nothing.
UNSEEN = [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]

_FOLD = {ord(c): " " for c in string.punctuation + string.whitespace + " “”‘’«»–—…·•"} | {c: None for c in UNSEEN}
_FOLD |= {ord(a): b for a, b in zip(HOMOGLYPHS[::2], HOMOGLYPHS[1::2], strict=True)} | {ord(a): b for a, b in DIGITS.items()}
_SIGN = re.compile("[@$](?=[a-z])")


def fold(text: str | None) -> str:
    """The folded words, each with one space before and after it."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower()
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return " ".join(["", *text.translate(_FOLD).split(), ""])


def beginnings(folded: str, least: int = 4, most: int = 9) -> set[str]:
    """The words, and their beginnings of ``least`` to ``most`` letters."""
    words = set(folded.split())
    return words | {w[:n] for w in words for n in range(least, min(most, len(w)) + 1)}


class Lexicon:
    """Terms with weights, exceptions, and the weights that calibrate the figures."""

    def __init__(self, terms: dict[str, float], exceptions=EXCEPTIONS):
        self.terms, self.exceptions, self._automaton = terms, tuple(fold(x).strip() for x in exceptions), None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                for form in {term, term.replace("l", "i")}:  # a digit one may stand for either
                    if form == term or form not in self.terms:
                        a.add_word(f" {form}", (len(form) + 1, weight))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 1, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def figures(self, text: str | None) -> tuple[float, float, float, float, float]:
        folded = fold(text)
        best: dict[int, tuple[int, float]] = {}
        safe = []
        if self.terms or self.exceptions:
            for end, (size, weight) in self.automaton().iter(folded):
                if weight is None:
                    safe.append((end - size, end))
                else:
                    start = end - size + 1
                    best[start] = max(best.get(start, (0, 0.0)), (size, weight))
        found, reach, at = [], -1, 0
        safe.sort()
        for start in sorted(best):  # both lists once, however long
            while at < len(safe) and safe[at][0] <= start:
                reach, at = max(reach, safe[at][1]), at + 1
            if reach <= start:
                found.append(best[start][1])
        total, words = sum(found), max(1, folded.count(" ") - 1)  # one space more than words
        return math.log1p(total), math.log1p(100 * total / words), float(len(found) > 0), float(len(found) > 1), math.log1p(words)


def held_out(id_col: str, folds: int = 4, fold_no: int = 2) -> Column:
    return F.coalesce(F.crc32(named(id_col).cast("string")) % folds == fold_no, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, allowed: Column) -> DataFrame:
    """``_text, _y``: a row for each of at most ``most`` labelled ids of the training folds, by the order of a hash of the id; of several texts of one id that of the least hash."""
    label, label_id = named(label_col), named(id_col)
    known = labels.where(label.isNotNull() & label_id.isNotNull() & allowed).groupBy(label_id.alias("_lid")).agg(F.max(label).cast("int").alias("_y"))
    few = F.broadcast(known.orderBy(F.xxhash64("_lid"), "_lid").limit(most))
    rows = docs.select(named(id_col).alias("_did"), named(text_col).alias("_text")).join(few, F.col("_did") == F.col("_lid"))
    text = F.coalesce("_text", F.lit(""))
    return rows.groupBy("_lid", "_y").agg(F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("t"))).alias("_one")).select(F.col("_one.t").alias("_text"), "_y")


def term_counts(sample: DataFrame) -> DataFrame:
    """``term, t, c``: in how many documents with and without the label each term stands."""

    def count(batches):
        for batch in batches:
            with_it, without = Counter(), Counter()
            for text, y in zip(batch.column("_text"), batch.column("_y").to_pylist(), strict=True):
                (with_it if y else without).update(beginnings(fold(text.as_py())))
            terms = list(with_it | without)
            counts = (pa.array([n[t] for t in terms], pa.int64()) for n in (with_it, without))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], names=["term", "t", "c"])

    return sample.mapInArrow(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def learn(sample: DataFrame, exceptions=EXCEPTIONS, least_docs: int = 5, least_weight: float = 1.5) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the calibration, from ``_text, _y`` of a bounded sample, which bounds the lexicon, too."""
    n = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    weight = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1)))
    chosen = term_counts(sample).where(F.col("t") >= least_docs).withColumn("w", weight).where(F.col("w") >= least_weight).collect()
    lexicon = Lexicon({r["term"]: r["w"] for r in chosen}, exceptions)

    def figures(batches):
        for batch in batches:
            rows = np.array([lexicon.figures(x.as_py()) for x in batch.column("_text")]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*[pa.array(rows[:, k]) for k in range(5)], batch.column("_y")], names=[*"abcde", "y"])

    data = np.array([tuple(r) for r in sample.mapInArrow(figures, "a double, b double, c double, d double, e double, y int").collect()], float).reshape(-1, 6)
    data = data[np.lexsort(data.T)]  # the same sum whatever the order of tasks
    return lexicon, logistic.fit(data[:, :5], data[:, 5])


def score(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cutoff: float = 0.3,
    most_rows: int = MOST_TRAINING_ROWS, exceptions=EXCEPTIONS,
) -> DataFrame:
    """Returns the id, held_out, score and predicted for every row.

    Null and empty texts hold no terms and get the score of a text without; rows with a null id are scored and not held out;
    repeated rows score alike, and one of them is learned from; several labels of one id count as the largest; without labels all scores are one half; very long
    texts are scored whole, in time that goes with their length; other columns are not looked at; no rows give no rows.
    """
    sample = materialize(training_sample(docs, labels, id_col, text_col, label_col, most_rows, ~held_out(id_col)), "toxicity-sample")
    lexicon, weights = learn(sample, exceptions)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = np.array([lexicon.figures(x.as_py()) for x in batch.column("_text")]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(logistic.score(rows, weights))], names=["_id", "held_out", "score"])

    out = docs.select(named(id_col).alias("_id"), held_out(id_col).alias("held_out"), named(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, held_out boolean, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
