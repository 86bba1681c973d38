"""Embedding whitening from a covariance by polarisation.

Entries become whole numbers, so every sum is exact. With n vectors x and sums S, y = n * x - S is centred. The tasks add up y_i ** 2 for every
dimension and (y_i + y_j) ** 2 for every pair; half of what the square of the sum has beyond the two squares is the sum of y_i * y_j, so that differences of
variances give all covariances. They are assembled into a matrix of dimensions by dimensions for ``eigh``, and the vectors are projected in their tasks.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.base import materialize, named

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: The matrix of so many dimensions at most is assembled on the driver.
MOST_DIMENSIONS = 4_096
#: Rows that a task squares at once.
_ROWS = 512
_LIMB = 21


def whole_numbers(rows: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector has only finite entries, and ``_x``, its whole numbers."""
    own = named(vector_col)
    finite = F.forall(own, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return rows.where(own.isNotNull() & finite).withColumn("_x", F.transform(own, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + SHIFT))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), d)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S; as Python's whole numbers where sums of two could leave 62 bits."""
    spread = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if spread < 1 << 60:
        return n * x - sums.astype(np.int64)
    y = n * x.astype(object) - sums
    return y.astype(np.int64) if np.abs(y).max(initial=0) < 1 << 60 else y


def square_sums(z: np.ndarray) -> list[int]:
    """The exact sum of squares of each column, ``z`` of at most 2 ** 18 rows."""
    if z.dtype == object:
        return [int(s) for s in (z * z).sum(axis=0)] if len(z) else [0] * z.shape[1]
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 1 << 62:
        return np.einsum("ij,ij->j", z, z).tolist()
    a, b, c = z >> (2 * _LIMB), (z >> _LIMB) & ((1 << _LIMB) - 1), z & ((1 << _LIMB) - 1)  # z = a * 2**42 + b * 2**21 + c
    part = lambda u, v: np.einsum("ij,ij->j", u, v).astype(object)
    total = (part(a, a) << 4 * _LIMB) + (part(a, b) << 3 * _LIMB + 1) + ((part(b, b) + 2 * part(a, c)) << 2 * _LIMB) + (part(b, c) << _LIMB + 1) + part(c, c)
    return [int(t) for t in total]


def _sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches):
        n, sums = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            sums += x.astype(object).sum(axis=0) if len(x) and int(np.abs(x).max()) > 1 << 40 else x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(n), *[Decimal(int(s)) for s in sums]], pa.decimal128(38, 0))], names=["i", "s"])

    rows = fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()  # a row a dimension
    known = {r["i"]: int(r["s"]) for r in rows}
    return known.get(-1, 0), np.array([known.get(i, 0) for i in range(d)], object)


def cross_sums(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """The exact sums of y_i * y_j over the vectors ``_x``, by polarisation; whole numbers of any size."""
    d = len(sums)
    one, other = np.triu_indices(d)

    def run(batches):
        total = np.zeros(len(one), object)
        for batch in batches:
            y = _centred(_matrix(batch.column(0), d), n, sums)
            for k in range(0, len(y), _ROWS):
                some = y[k : k + _ROWS]
                # of a dimension with itself the value, of two dimensions their sum
                total += np.array(square_sums(np.where(one == other, some[:, one], some[:, one] + some[:, other])), object)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(one)), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["k", "s"])

    rows = fit.mapInArrow(run, "k int, s decimal(38,0)").groupBy("k").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()  # a row a pair of dimensions
    found = np.zeros((d, d), object)
    for r in rows:
        found[one[r["k"]], other[r["k"]]] = int(r["s"])
    own = np.diag(found).copy()
    for i, j in zip(one, other, strict=True):
        if i != j:
            found[i, j] = found[j, i] = (found[i, j] - own[i] - own[j]) // 2
    return found


def _principal(cross: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (in columns) of the covariance by falling value, those above rounding, and each one's share of the trace."""
    cov = np.array([[v / n**3 for v in row] for row in cross.tolist()])  # quotients of whole numbers, rounded once
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors, trace = values[order], vectors[:, order], np.trace(cov)
    real = values > max(values[0], 0) * len(values) * np.finfo(float).eps
    keep = np.flatnonzero(real)[:most]
    return values[keep], vectors[:, keep], values[keep] / trace


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each row and component: the id column, component (from 1, by falling eigenvalue), n (vectors fitted), deviation (sum of (n * x - S) ** 2, exact,
    decimal(38,0)), whitened, explained (the eigenvalue's share of the trace), identity_error (the largest entry by which the covariance of
    ``whitened`` over the fitted vectors, summed from their values, departs from the identity).

    Each distinct vector is fitted once. Rows go whose vector is null or has null, infinite or NaN entries, and those of another length than most rows have (of
    lengths as frequent, the longest counts). Components without variance beyond rounding are left out, so equal vectors give no rows, and neither do
    no rows or vectors without entries. Null ids stay null, repeated rows each have their rows, other columns are not looked at.
    """
    clean = whole_numbers(rows, vector_col).select(named(id_col).alias("_id"), "_x")
    sizes = clean.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions are too many for one matrix; at most {MOST_DIMENSIONS}")
    clean = clean.where(F.size("_x") == d)
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    nothing = rows.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    if not d:
        return nothing
    fit = materialize(clean.select("_x").distinct(), "whitening-fit")
    n, sums = _sums(fit, d)
    values, vectors, share = _principal(cross_sums(fit, n, sums), n, components)
    k = len(values)
    if not k:
        return nothing
    scaled = vectors / (n * np.sqrt(values))  # y times it is whitened

    def second_moments(batches):
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = _centred(_matrix(batch.column(0), d), n, sums).astype(float) @ scaled
            total, first = total + w.T @ w, first + w.sum(axis=0)
        numbers = np.concatenate((total.ravel(), first))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int32()), pa.array(numbers)], names=["k", "s"])

    moments = np.zeros(k * k + k)
    for r in fit.mapInArrow(second_moments, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        moments[r["k"]] = r["s"] / n
    mean = moments[k * k :]
    error = float(np.abs(moments[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())

    def project(batches):
        for batch in batches:
            for part in (batch.slice(a, 4_096) for a in range(0, len(batch), 4_096)):
                y = _centred(_matrix(part.column(1), d), n, sums)
                m = len(y)
                deviation = [Decimal(s) for s in square_sums(np.ascontiguousarray(y.T))] if m else []
                where = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(where), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviation, pa.decimal128(38, 0)).take(where),
                    pa.array((y.astype(float) @ scaled).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ], names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return clean.mapInArrow(project, schema).withColumnRenamed("_id", id_col)
