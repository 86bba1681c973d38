import math
import random

import numpy as np
import pytest

from loomlog.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Whole numbers of Python, one covariance after another; (id, component) -> n, deviation, |whitened|, explained."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in good}]
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    y = np.array([[n * x[i] - sums[i] for i in range(d)] for x in fit], object)
    cov = np.array([[int(v) / n**3 for v in row] for row in y.T @ y])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for at, (i, x) in enumerate(good):
        own = [n * a - s for a, s in zip(x, sums, strict=True)]
        for c in range(min(16, d)):
            white = float(np.dot([v / n for v in own], vectors[:, c])) / math.sqrt(values[c])
            out[at, i, c + 1] = (n, sum(v * v for v in own), abs(white), values[c] / values.sum())
    return out


def check(df, rows):
    want = {}
    for (_, i, c), v in brute(rows).items():
        want.setdefault((i, c), []).append(v)
    got = {}
    found = df.collect()
    for r in found:
        got.setdefault((r["vec_id"], r["component"]), []).append((r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"]))
    assert got.keys() == want.keys()
    for k, values in want.items():
        for a, b in zip(sorted(got[k]), sorted(values), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-7, abs=1e-7)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op12_embedding_whitening(spark, SF), rows)


def test_cross_sums_by_polarisation(spark):
    rng = np.random.default_rng(1)
    for scale in (50, 10**6, 10**12):
        x = rng.integers(-scale, scale, (300, 7))
        fit = spark.createDataFrame([(row.tolist(),) for row in x], "_x array<long>")
        n, sums = whitening._sums(fit, 7)
        y = [[n * int(a) - int(s) for a, s in zip(row, sums, strict=True)] for row in x]
        assert (n, sums.tolist()) == (300, [int(v) for v in x.sum(axis=0)])
        want = [[sum(row[i] * row[j] for row in y) for j in range(7)] for i in range(7)]
        assert whitening.cross_sums(fit, n, sums).tolist() == want


def test_square_sums_in_limbs():
    rng = random.Random(2)
    for bits in (8, 30, 45, 61):
        z = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(40)]
        want = [sum(row[j] ** 2 for row in z) for j in range(5)]
        assert whitening.square_sums(np.array(z, np.int64)) == want == whitening.square_sums(np.array(z, object))


def test_edge_cases(spark):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(5)]) for k in range(60)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1]), (None, None), (90, [0.5, None, 0.1, 0.2, 0.3]), (91, [0.5, float("nan"), 0.1, 0.2, 0.3]), (92, [0.5, float("inf"), 0.1, 0.2, 0.3])]
    schema = "vec_id long, embedding array<double>, n string, _x int"
    docs = spark.createDataFrame([(*r, "n", 7) for r in [*rows, (93, [1.0, 2.0]), (94, [])]], schema)
    check(whitening.whiten(docs), rows)
    assert whitening.whiten(docs.limit(0)).count() == 0
    assert whitening.whiten(docs.where("vec_id in (5)")).count() == 0  # one vector has no variance
    assert whitening.whiten(docs.where("vec_id = 94")).count() == 0


def test_equal_dimensions_leave_components_out(spark):
    rng = random.Random(5)
    rows = [(k, [a := rng.uniform(-1, 1), a, rng.uniform(-1, 1), 1.0]) for k in range(50)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(docs).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 100
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1)
    assert got[0]["identity_error"] < 1e-9
