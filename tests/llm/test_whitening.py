"""Whitening against a plain eigendecomposition with numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostscope.llm import whitening as wh

ROWS = "vec_id long, embedding array<double>"


def brute(rows, components=4):
    """vec_id -> (deviation, whitened row) and (n, explained)."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n = len(fit)
    sums = [sum(int(c) for c in column) for column in fit.T]
    centred = fit - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for i, x in good:
        deviation = sum((n * int(c) - s) ** 2 for c, s in zip(x, sums))
        out[i] = deviation, (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)
    return out, n, values / np.trace(centred.T @ centred / n)


def compare(df, rows):
    want, n, explained = brute(rows)
    got = wh.whiten(df).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i in want for c in range(1, 5))
    sign = {}
    for r in sorted(got, key=lambda r: (r.component, -abs(want[r.vec_id][1][r.component - 1]))):
        z = want[r.vec_id][1][r.component - 1]
        sign.setdefault(r.component, 1 if r.whitened * z > 0 else -1)
        assert (r.n, int(r.deviation)) == (n, want[r.vec_id][0])
        assert abs(r.whitened * sign[r.component] - z) < 1e-8
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def vectors(n=300, d=12, offset=0.0, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * np.linspace(0.2, 3, d) + offset
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_equals_numpy(spark):
    rows = vectors()
    rows += [(1_000 + i, rows[i % 3][1]) for i in range(200)]  # copies count once in the fit
    compare(spark.createDataFrame(rows, ROWS).repartition(5), rows)


def test_far_from_the_origin(spark):
    """Products of uncentred entries would lose the variance."""
    rows = vectors(offset=1e9)
    compare(spark.createDataFrame(rows, ROWS), rows)


def test_odd_rows_and_clashing_columns(spark):
    rows = vectors(60, 5)
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (905, [1.0, 2.0]), (906, [-0.0] * 5)]
    df = spark.createDataFrame(rows + odd, ROWS).withColumn("x", F.lit("q")).withColumn("n", F.lit(1)).withColumn("component", F.lit("z"))
    compare(df, rows + [odd[-1]])
    null_id = wh.whiten(spark.createDataFrame([*rows, (None, rows[0][1])], ROWS)).where("vec_id IS NULL")
    assert null_id.count() == 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance_there_are_no_components(spark, rows):
    assert wh.whiten(spark.createDataFrame(rows, ROWS)).count() == 0


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    got = wh.whiten(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e13 * (i % 7), float(i)]) for i in range(20)]
    want, _, _ = brute(rows, 2)
    got = {r.vec_id: int(r.deviation) for r in wh.whiten(spark.createDataFrame(rows, ROWS), components=2).where("component = 1").collect()}
    assert got == {i: w[0] for i, w in want.items()}


def test_jacobi_on_graded_and_tied_spectra():
    r = np.random.default_rng(4)
    for d, scale in [(1, [3.0]), (7, 10.0 ** np.arange(7)), (16, np.ones(16)), (33, np.r_[np.ones(20), np.zeros(13)])]:
        q, _ = np.linalg.qr(r.normal(size=(d, d)))
        v = (q * scale) @ q.T
        values, axes = wh.one_sided_jacobi(wh.pivoted_cholesky((v + v.T) / 2))
        want = np.sort(np.asarray(scale, float))[::-1]
        want = want[want > 0]
        assert len(values) == len(want) and np.allclose(values, want, rtol=1e-6, atol=0)
        assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-10)
        assert np.allclose((axes * values) @ axes.T, v, atol=1e-8 * want[0])
