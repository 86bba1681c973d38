"""The pipeline against brute force, stage by stage on the stage's own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from loomlog.llm import jaccard_join, simhash
from loomlog.llm.base import by_bitmap, materialize, only_rows
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_jaccard_join import brute as brute_jaccard
from tests.llm.test_packing import check
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_scans import base as secrets
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outs = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        outs.append(materialize(stage(spark, outs[-1], SF), "test"))
    assert all(x.columns == columns for x in outs[:-1])
    start, good, single, clean, safe = (rows_of(x) for x in outs[:-1])
    assert set(good) == {r for r in start if not brute_quality(r[1])[5]}  # too few labels here to certify a cutoff
    groups = {}
    for doc_id, _, component in brute_components([(r[0], brute_print(r[1])) for r in good]):
        groups.setdefault(component, []).append(doc_id)
    first = {min(g) for g in groups.values()}
    assert sorted(r[0] for r in single) == sorted(d for d, _, c in brute_jaccard([r[:2] for r in good if r[0] in first], 5, 80) if d == c)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _, _ in brute_leaks([r[:2] for r in single], items)}
    assert bad and rows_of(outs[3]) == [r for r in single if r[0] not in bad]
    assert len(safe) == len(clean)
    for before, after in zip(clean, safe, strict=True):
        assert not secrets(after[1])
        assert after[4] == len(after[1])
        if not secrets(before[1]) and "[SECRET]" not in after[1]:
            assert before == after
    check(outs[-1].collect(), [r[:2] for r in safe], 1024)


def test_empty_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), SF).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    odd = spark.createDataFrame([(None, text, None, None, None), (None, text, None, None, None), (None, None, None, None, 3)], docs.schema)
    assert corpus_pipeline.drop_near_duplicates(spark, odd, SF).count() == 2
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, SF)
    assert odd.count() == 1


def test_run_is_the_stages_and_leaves_only_the_last_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test")
    want = corpus_pipeline.pack(spark, docs, SF)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(want)


CLASHING = ["a.b", "_row", "_id", "_key", "_text", "kept", "n_words", "start", "score", "item_id", "spans", "_fp"]
TEXT = " ".join(f"w{k}" for k in range(40))
LONG = " ".join(f"long{k}" for k in range(120_000)) + " token=abcdef123"


def odd_rows(spark, docs):
    rows = [(1, TEXT, "en", "s", 5), (1, TEXT, "en", "s", 5), (2, TEXT, None, None, None), (None, TEXT + " tail", "en", "s", 1), (3, None, "en", "s", None), (4, "", "xx", "s", 0), (5, LONG, "en", "t", len(LONG)), (None, None, None, None, None)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", `{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], schema)


def test_every_stage_takes_odd_rows_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = odd_rows(spark, docs)
    out = {name: stage(spark, odd, SF) for name, stage in corpus_pipeline.STAGES}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert out[name].columns == odd.columns, name
        assert all(r["a.b"] == r["_id"] == r["kept"] == "x" for r in out[name].collect()), name
    ids = lambda name: sorted((str(r["doc_id"]) for r in out[name].collect()))
    assert ids("quality rules") == ["1", "1", "2", "5", "None"]
    assert ids("SimHash near-dedup") == ["1", "3", "5"]
    assert ids("benchmark decontamination") == sorted(map(str, [1, 1, 2, None, 3, 4, 5, None]))
    assert ids("secret scans") == sorted(map(str, [1, 1, 2, None, 3, 4, 5, None]))
    long = next(r for r in out["secret scans"].collect() if r["doc_id"] == 5)
    assert long["text"].endswith(" [SECRET]") and long["n_chars"] == len(long["text"])
    check(out["best-fit packing"].collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 1024)


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_near_duplicates_shuffle_no_whole_rows_that_stay(spark):
    """Both steps shuffled all texts, to join them with the ids of those that stay; now only texts that may go are moved."""
    big, few = 300_000, 20
    rows = spark.range(few).selectExpr("id as doc_id", f"concat_ws(' ', transform(sequence(1, {big // 20}), x -> hex(xxhash64(id, x)))) as text", "'en' as lang", "'s' as source", "1L as n_chars")
    docs = materialize(rows.union(rows.where("doc_id < 2").selectExpr("doc_id + 100", "text", "lang", "source", "n_chars")), "test")
    for keep_one in (simhash.keep_one, jaccard_join.keep_one):
        got = keep_one(docs)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan and "LeftSemi" not in plan  # rows that surely stay pass beside the join
        assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == list(range(few))


def test_rows_told_apart_by_a_bitmap(spark):
    keys = spark.range(0, 4000).selectExpr("case when id % 10 = 0 then null else id end as _id", "xxhash64(id) as _key", "id as at")
    for part in (7, 3900):
        kept, rest = keys.where(f"at < {part}").select("_id", "_key"), keys.where(f"at >= {part}").select("_id", "_key")
        doubtful, sure = by_bitmap(keys, rest, "_key")
        assert doubtful.union(sure).select("at").distinct().count() == doubtful.count() + sure.count() == 4000
        assert 4000 - part <= doubtful.count() <= 4000 - part + 20 and sure.where(f"at >= {part}").isEmpty()
        assert sorted(r["at"] for r in only_rows(keys, kept, rest).collect()) == list(range(part))
    same_key = spark.createDataFrame([(1, 5), (2, 5), (None, 5)], "_id long, _key long")  # a bitmap of keys cannot tell these
    for gone in (1, None):
        rest = same_key.where(F.col("_id").eqNullSafe(F.lit(gone)))
        kept = same_key.exceptAll(rest)
        assert {r["_id"] for r in only_rows(same_key, kept, rest).collect()} == {1, 2, None} - {gone}
    assert only_rows(same_key, same_key.limit(0), same_key).count() == 0 and only_rows(same_key, same_key, same_key.limit(0)).count() == 3
