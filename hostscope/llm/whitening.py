"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided
Jacobi directly on the triangular factor.

The covariance ``V`` of the fit list is factored as ``L L'`` with the largest
remaining diagonal entry as pivot, which also finds the rank.  Jacobi rotations
from the right make the columns of ``L`` orthogonal: their squared norms are the
eigenvalues of ``V`` and the normalised columns its unit eigenvectors, to high
relative accuracy and without forming or iterating on ``V`` again.

Spark does everything that grows with rows: the distinct list, the sums, the
scatter (summed per task, then by matrix row), the check of the whitened
covariance and the projection.  The driver holds one d x d matrix, where d is the
length of a vector, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostscope.llm import common as C

MAX_DIMENSION = 4_096  # the driver holds a matrix of this order at most
SWEEPS = 60
EPS = float(np.finfo(float).eps)


# ------------------------------------------------------------ the small matrix


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``L`` (d x rank) with ``L L' = v``, in the order of the original rows;
    pivots below d * eps times the largest diagonal entry count as zero."""
    d = len(v)
    rest = np.diag(v).astype(float).copy()
    least = d * EPS * rest.max(initial=0.0)
    columns: list[np.ndarray] = []
    open_rows = np.ones(d, bool)
    for _ in range(d):
        at = int(np.argmax(np.where(open_rows, rest, -np.inf)))
        if not rest[at] > least:
            break
        column = v[:, at].astype(float).copy()
        for done in columns:
            column -= done * done[at]
        column[~open_rows] = 0.0
        column /= np.sqrt(rest[at])
        column[at] = np.sqrt(rest[at])
        open_rows[at] = False
        rest -= column * column
        columns.append(column)
    return np.stack(columns, 1) if columns else np.zeros((d, 0))


def one_sided_jacobi(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of ``lower lower'``.
    A sweep meets all pairs of columns in rounds of disjoint pairs, each round
    one vector operation."""
    a = lower.astype(float).copy()
    n = a.shape[1]
    seats = np.arange(n + n % 2)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(len(seats) - 1, 0)):
            p, q = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            real = (p < n) & (q < n)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(xx * yy)
            turn = np.abs(xy) > EPS * scale
            if turn.any():
                worst = max(worst, float((np.abs(xy[turn]) / scale[turn]).max()))
                zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                x, y = x[:, turn], y[:, turn]
                a[:, p[turn]], a[:, q[turn]] = c * x - s * y, s * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 4 * EPS:
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, a[:, order] / norms[order]


# -------------------------------------------------------------- tasks on batches


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch of equally long lists of longs as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int):
    """One row a task: rows seen and the exact sum of every dimension."""

    def run(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n += len(x)
            if len(x):
                low, high = int(x.min()), int(x.max())
                safe = max(abs(low), abs(high)) * len(x) < 1 << 62
                part = (x if safe else x.astype(object)).sum(0)
                total = [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d, dtype=np.int32)), pa.array([n] * d, pa.int64()),
             pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["dim", "n", "total"])

    return run


def _scatter(mean: np.ndarray):
    """d rows a task: the rows of its part of the centred scatter."""
    d = len(mean)

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            y = _matrix(batch.column("x"), d).astype(float) - mean
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
            names=["dim", "part"])

    return run


def _add_rows(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        part = _matrix(batch.column("part"), len(batch.column("part")[0])).sum(0)
        total = part if total is None else total + part
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["dim", "part"])


def _projected(mean: np.ndarray, axes: np.ndarray):
    """The whitened coordinates of every row, as ``z: array<double>``."""

    def run(batches):
        for batch in batches:
            z = (_matrix(batch.column("x"), len(mean)).astype(float) - mean) @ axes
            yield pa.RecordBatch.from_arrays([pa.array(list(z), pa.list_(pa.float64()))], names=["z"])

    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal]:
    largest = max((max(abs(n * int(x.min())), abs(n * int(x.max()))) if x.size else 0), 1)
    largest += max(map(abs, sums), default=0)
    if largest * largest * max(x.shape[1], 1) < 1 << 62:
        y = x * n - np.array(sums, np.int64)
        return [Decimal(int(v)) for v in (y * y).sum(1)]
    y = x.astype(object) * n - np.array(sums, object)
    return [Decimal(int(v)) for v in (y * y).sum(1)]


def _whitened(n: int, sums: list[int], axes: np.ndarray):
    """One row per input row and component."""
    mean, k = _mean(n, sums), axes.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), len(mean))
            z = (x.astype(float) - mean) @ axes
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = _deviations(x, n, sums)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array([v for v in deviation for _ in range(k)], pa.decimal128(38, 0)),
                 pa.array(np.ascontiguousarray(z).ravel())],
                names=["vec_id", "component", "deviation", "whitened"])

    return run


def _mean(n: int, sums: list[int]) -> np.ndarray:
    """S / n, each correctly rounded."""
    return np.array([s / n for s in sums], float)


# ------------------------------------------------------------------ the operator


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per remaining row of ``vectors`` and component (from 1, by falling
    eigenvalue): ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    An entry c counts as floor(scale * c).  The fit list holds each distinct such
    vector once; n is its length, S its sum, V its covariance with divisor n.
    ``deviation`` is the exact sum over dimensions of (n * x - S)^2 as
    decimal(38,0); ``whitened`` is (x - S / n) on the unit eigenvector, over the
    root of the eigenvalue; ``explained`` the eigenvalue over the trace;
    ``identity_error`` how far the whitened covariance is from the identity.

    Rows whose vector is null, empty or holds a null or non-finite entry are left
    out, as are those of another length than the commonest (the longest of equally
    common ones).  Entries outside the range of a long count as its end.  Repeated
    rows are returned as often and count once in the fit; a null id is returned as
    null.  Components beyond the rank of V do not exist: an empty table, one
    distinct vector or equal vectors give no rows.  Other columns are ignored,
    whatever their names; vectors longer than ``MAX_DIMENSION`` and deviations of
    more than 38 digits are refused.
    """
    spark = vectors.sparkSession
    C.python_ready(spark)
    entry = F.col("v")
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    ).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists(
        "v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    columns = "vec_id, component, n, deviation, whitened, explained, identity_error"
    empty = rows.select(
        "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("decimal(38,0)").alias("deviation"),
        *[F.lit(None).cast("double").alias(c) for c in ("whitened", "explained", "identity_error")]).limit(0)
    if common is None:
        return empty
    d = common.d
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of {d} entries; at most {MAX_DIMENSION} are supported")
    rows = rows.where(F.size("v") == d).select(
        "vec_id", F.transform(entry, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))

    fit = C.stored(rows.select("x").distinct(), "fit")
    by_dim = {r.dim: r for r in fit.mapInArrow(_sums(d), "dim int, n long, total decimal(38,0)").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}  # d rows
    n, sums = int(by_dim[0].n), [int(by_dim[i].total) for i in range(d)]
    mean = _mean(n, sums)
    parts = fit.mapInArrow(_scatter(mean), "dim int, part array<double>").groupBy("dim").applyInArrow(
        _add_rows, "dim int, part array<double>")
    v = np.zeros((d, d))
    for r in parts.collect():  # d rows of d entries
        v[r.dim] = r.part
    v = (v + v.T) / (2 * n)

    values, vectors_ = one_sided_jacobi(pivoted_cholesky(v))
    k = min(components, len(values))
    if not k:
        C.discard(fit)
        return empty
    axes = vectors_[:, :k] / np.sqrt(values[:k])
    z = fit.mapInArrow(_projected(mean, axes), "z array<double>").select(
        *[F.col("z")[i].alias(f"z{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = z.agg(*[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    C.discard(fit)

    trace = float(np.trace(v))
    explained = F.element_at(F.array(*[F.lit(float(e) / trace) for e in values[:k]]), F.col("component"))
    out = rows.mapInArrow(
        _whitened(n, sums, axes),
        f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, deviation decimal(38,0), whitened double")
    return out.withColumns({
        "n": F.lit(n).cast("long"), "explained": explained, "identity_error": F.lit(float(error)),
    }).selectExpr(*columns.split(", "))
