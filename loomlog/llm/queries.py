"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import conversation_repair, decontaminate, jaccard_join, licenses, oracles, packing, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup
from loomlog.llm import token_counts, toxicity, whitening
from loomlog.llm.base import scratch, table

#: With five rules, holdouts of about 150 good documents a stratum certify a cutoff at this rate; the default of 0.05 needs about 600.
WIDE_ALPHA = 0.2


def _counted(spark: SparkSession, sf_dir: str, *versions: str) -> DataFrame:
    """The totals of the whole table, reached by deltas: documents of over 20,000 characters are inserted with their first line and revised to
    the whole text, those of fewer than five words are deleted and inserted again, and every batch comes twice, before and after a compaction."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.TokenRollup(spark, scratch(spark, "rollup"))
    first_line = F.regexp_replace("text", r"(?s)\n.*", "")
    long = F.col("n_chars") > 20000
    five_words = F.coalesce("text", F.lit("")).rlike(r"\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){4}[^\x20\x09-\x0D]")
    begun, short = docs.withColumn("text", F.when(long, first_line).otherwise(F.col("text"))), docs.where(~five_words)
    deltas = {
        "insert": token_counts.inserts(begun, *versions),
        "revise": token_counts.revisions(docs.where(long), *versions, old_text=first_line, new_text=F.col("text")),
        "delete": token_counts.deletes(short, *versions),
        "restore": token_counts.inserts(short, *versions),
    }
    for name, rows in deltas.items():
        rollup.commit(name, rows)
        rollup.commit(name, rows)
        rollup.compact()
    rollup.commit("insert", deltas["insert"])
    return rollup.totals()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of the whole table under every tokenizer version."""
    return _counted(spark, sf_dir, *token_counts.VERSIONS)


def op1_token_counts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the two tokenizer versions that SQL can express."""
    return _counted(spark, sf_dir, "words-1", "marks-1")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("_row.doc_id", *quality_rules.BASE, "base_failed", "kept")


def op2_quality_rules_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a false rejection rate that small holdouts can certify cutoffs for."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), alpha=WIDE_ALPHA)
    return judged.select("_row.doc_id", *quality_rules.BASE, "base_failed", "kept")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("_row.doc_id", "*").drop("_row", "_marked")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("_key", "_root")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("_key")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).drop("_key", "_root")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repairs of damaged conversations; those of which no row is left have zeros, no edits and the hash of nothing."""
    conversations = table(spark, sf_dir, "conversations")
    found, _ = conversation_repair.repair(conversation_repair.damage(conversations))
    every = conversations.select("conv_id").distinct()
    found = found.withColumnRenamed("conv_id", "_conv")
    out = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


QUERIES = (
    op1_token_counts, op1_token_counts_whole, op2_quality_rules, op2_quality_rules_wide, op3_quality_classifier, op4_substring_dedup, op5_secret_scan, op6_toxicity,
    op7_benchmark_decontamination, op8_simhash_near_dedup, op9_license_scan, op10_best_fit_packing, op11_jaccard_join, op12_embedding_whitening,
    op13_conversation_repair,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_token_counts_whole": oracles.token_counts_sql(),
        "op2_quality_rules": oracles.quality_sql(),
        "op2_quality_rules_wide": oracles.quality_sql(alpha=WIDE_ALPHA),
        "op5_secret_scan": oracles.secrets_sql(),
        "op9_license_scan": oracles.licenses_sql(),
        "op11_jaccard_join": oracles.jaccard_sql(),
        "op13_conversation_repair": oracles.repair_sql(),
    }
