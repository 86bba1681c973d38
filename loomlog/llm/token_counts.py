"""Token counts as rollups that are kept up to date by signed deltas.

A delta says by how much the documents and tokens of a source, language and tokenizer version change: an insert adds a
document and its tokens, a delete takes them away, a revised count adds the difference. Totals are sums of deltas, so
batches may be applied in any order. A batch is written below its own id, pre-aggregated, in one committed write; a batch whose
commit is there is not applied again, and one that broke off is overwritten. Reading sums the committed batches;
``compact`` folds those that are there when it begins into one base, which remembers their ids, so a batch committed meanwhile stays
as it is. What a base has folded is removed one compaction later, so that readers of the state before it can end.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.base import named, words_of

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens")
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def word_tokens(text: Column) -> Column:
    """Words apart by white space."""
    return F.size(words_of(text)).cast("long")


def mark_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits and of characters beyond ASCII; each other character but white space by itself."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x00-\x20]")).cast("long")


def bpe_tokens(text: Column, tokenizer_path: str | None = None) -> Column:
    """Ids of the byte-level BPE, in Arrow batches."""
    from loomlog.llm.tokenizer import tokenizer

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in tokenizer(tokenizer_path).encode([t or "" for t in texts])], dtype="int64")

    return count(text)


#: Tokenizer versions and what counts their tokens.
VERSIONS: dict[str, Callable[[Column], Column]] = {"words-1": word_tokens, "marks-1": mark_tokens, "byte_bpe_50k": bpe_tokens}


def inserts(docs: DataFrame, *versions: str, text_col: str = "text") -> DataFrame:
    """Deltas that add the documents under each version, from one pass over the texts."""
    return _deltas(docs, versions, 1, lambda count: count(named(text_col)))


def deletes(docs: DataFrame, *versions: str, text_col: str = "text") -> DataFrame:
    """Deltas that take the documents away again, as ``inserts`` added them."""
    return _deltas(docs, versions, -1, lambda count: -count(named(text_col)))


def revisions(docs: DataFrame, *versions: str, old_text: Column, new_text: Column) -> DataFrame:
    """Deltas that put new texts in place of old ones: as many documents, the difference of the tokens."""
    return _deltas(docs, versions, 0, lambda count: count(new_text) - count(old_text))


def _deltas(docs: DataFrame, versions: tuple[str, ...], n_docs: int, tokens: Callable[[Callable[[Column], Column]], Column]) -> DataFrame:
    counts = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *[tokens(VERSIONS[v]).alias(f"_{k}") for k, v in enumerate(versions)])
    # summed by version before rows are made of versions
    sums = counts.groupBy("source", "lang").agg(F.count("*").alias("_n"), *[F.sum(f"_{k}").alias(f"_{k}") for k in range(len(versions))])
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col(f"_{k}").alias("n_tokens")) for k, v in enumerate(versions)])
    return sums.select("source", "lang", F.inline(each), (F.col("_n") * n_docs).alias("n_docs")).select(*KEYS, *SUMS)


class TokenRollup:
    """The rollup kept under ``root``, a folder that all executors share.

    Null sources and languages are keys of their own; null and empty texts have no tokens but are documents; repeated rows count each; very long texts count whole; a batch without rows is committed
    and changes nothing; keys whose documents and tokens sum to zero are left out; an id is letters, digits, ``_.-``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _committed(self, path: str) -> bool:
        fs, at = self._fs(f"{path}/_SUCCESS")
        return fs.exists(at)

    def batches(self) -> list[str]:
        """Ids of the committed batches that stand alone (not yet compacted)."""
        return sorted(x for x in self._names("batch=") if self._committed(f"{self.root}/batch={x}"))

    def _names(self, kind: str) -> list[str]:
        fs, at = self._fs(self.root)
        return [s.getPath().getName().removeprefix(kind) for s in fs.listStatus(at) if s.getPath().getName().startswith(kind)] if fs.exists(at) else []

    def _bases(self) -> list[int]:
        """Numbers of the committed compactions."""
        return sorted(int(x) for x in self._names("base=") if self._committed(f"{self.root}/base={x}/ids"))

    def _folded(self, base: int | None, ids: list[str]) -> set[str]:
        """Which of the ids a compaction holds; its own list stays where it is."""
        if base is None or not ids:
            return set()
        held = self.spark.read.schema("id string").parquet(f"{self.root}/base={base}/ids")
        return {r[0] for r in held.where(F.col("id").isin(ids)).collect()}

    def _state(self) -> tuple[int | None, list[str], list[str]]:
        """The newest compaction, the batches it does not hold, and those it does but that are still there.

        Batches are listed before compactions: a batch folded in between is then found in the newer base, none is missed.
        """
        batches, bases = self.batches(), self._bases()
        base = bases[-1] if bases else None
        held = self._folded(base, batches)
        return base, [b for b in batches if b not in held], [b for b in batches if b in held]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Applies a batch once: False if it was committed before. One id must not be written from two places at once."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError(f"bad batch id {batch_id!r}")
        path, bases = f"{self.root}/batch={batch_id}", self._bases()
        if self._committed(path) or bases and self._folded(bases[-1], [batch_id]):
            return False
        self._summed(deltas).write.mode("overwrite").parquet(path)
        return True

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])

    def _rows(self, base: int | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.root}/batch={b}" for b in batches] + ([f"{self.root}/base={base}/rows"] if base is not None else [])
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return self._summed(rows).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        base, batches, _ = self._state()
        return self._rows(base, batches)

    def compact(self) -> None:
        """Folds the batches committed so far into a new base, which counts once its ids are written, after its rows.

        One compaction at a time; commits may go on meanwhile. Batches that the base before had folded, and the bases before that, are removed.
        """
        base, batches, done = self._state()
        if not batches:
            return
        path = f"{self.root}/base={0 if base is None else base + 1}"
        self._rows(base, batches).write.mode("overwrite").parquet(f"{path}/rows")
        ids = self.spark.createDataFrame([(x,) for x in batches], "id string")
        if base is not None:
            ids = ids.union(self.spark.read.schema("id string").parquet(f"{self.root}/base={base}/ids"))
        ids.sort("id").write.mode("overwrite").parquet(f"{path}/ids")
        for old in [f"batch={x}" for x in done] + [f"base={x}" for x in self._bases() if base is not None and x < base]:
            fs, at = self._fs(f"{self.root}/{old}")
            fs.delete(at, True)
