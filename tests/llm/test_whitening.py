import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import whitening


def plain_whitening(vectors, most=16):
    """Brute force per length, with the covariance and a dense solver: n, deviation, projections and explained shares."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v)]
    out = []
    for d in {len(v) for _, v in good}:
        rows = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in good if len(v) == d]
        fit = sorted({tuple(x) for _, x in rows})
        n, sums = len(fit), [sum(x[j] for x in fit) for j in range(d)]
        centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
        values, vecs = np.linalg.eigh(centred.T @ centred / n)
        values, vecs = values[::-1], vecs[:, ::-1]
        for i, x in rows:
            dev = [n * c - s for c, s in zip(x, sums)]
            for k in range(min(most, d)):
                if values[k] > 1e-12 * max(values[0], 0) and values[k] > 0:
                    w = np.array(dev) / n @ vecs[:, k] / math.sqrt(values[k])
                    out.append((i, k + 1, n, sum(a * a for a in dev), w, values[k] / values.sum()))
    return out


def compare(spark, rows, exact=1e-8):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, x int")
    got = whitening.whiten(df).collect()
    want = plain_whitening(rows)
    key = lambda r: (str(r[0]), r[1], r[2], r[3], round(abs(r[4]), 6))
    got_rows = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got_rows] == [r[:4] for r in want]
    signs = {}
    for g, w in zip(got_rows, want):
        assert abs(abs(g[4]) - abs(w[4])) < exact and g[5] == pytest.approx(w[5], rel=1e-9)
        if abs(w[4]) > 1e-3:
            signs.setdefault((g[2], g[1]), set()).add(g[4] * w[4] > 0)
    assert all(len(s) == 1 for s in signs.values())  # one sign per component
    assert all(r["identity_error"] < 1e-10 and r["residual"] < 1e-12 for r in got)


def floats(x):
    return [[float(c) for c in v] for v in np.asarray(x, np.float32)]


def test_given_vectors_against_a_dense_solver(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    compare(spark, [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_repeated_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = list(enumerate(floats(rng.standard_normal((120, 20)) * np.linspace(0.2, 4, 20))))
    rows += [(5, rows[5][1]), (900, rows[6][1]), (None, rows[7][1])] * 3  # copies count once in the fit
    rows += [(1, None), (2, []), (3, [float("nan")] * 20), (4, [float("inf")] + [0.0] * 19), (6, [None] * 20), (7, [-0.0] * 20)]
    rows += [(2000 + i, v) for i, v in enumerate(floats(rng.standard_normal((30, 3))))]  # another length: whitened apart
    compare(spark, rows)


def test_flat_and_single_vectors(spark):
    """Directions without spread have no component: a plane in ten dimensions has two, one distinct vector none."""
    rng = np.random.default_rng(5)
    plane = rng.integers(-64, 64, (50, 2)) / 64
    turned = np.zeros((50, 10))
    turned[:, 3], turned[:, 8] = plane[:, 0], plane[:, 1]
    compare(spark, list(enumerate(floats(turned))))
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    assert set(whitening.whiten(df.limit(0)).columns) == set(whitening.whiten(df).columns)


def test_huge_entries_have_exact_or_null_deviations(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: None}
    df = spark.createDataFrame([(1, [1e6, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    xs = {1: [64 * 10**6, 0], 2: [0, 64], 3: [64, 0]}
    sums = [sum(x[j] for x in xs.values()) for j in range(2)]
    assert got == {i: sum((3 * a - s) ** 2 for a, s in zip(x, sums)) for i, x in xs.items()}


@pytest.mark.parametrize("d, seed", [(1, 0), (7, 1), (40, 2), (200, 3), (400, 4)])
def test_eigenpairs(d, seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((3 * d + 5, d)) * np.linspace(0.5, 3, d)
    v = a.T @ a / len(a)
    calls = []
    values, vectors, residual = whitening.eigenpairs(lambda t: calls.append(1) or v @ t, d)
    want, basis = np.linalg.eigh(v)
    k = min(16, d)
    assert np.allclose(values, want[::-1][:k], rtol=1e-12)
    assert np.allclose(np.abs((vectors * basis[:, ::-1][:, :k]).sum(axis=0)), 1, atol=1e-9)
    assert residual < 1e-13 and len(calls) < 200


def test_equal_eigenvalues_are_all_found():
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.standard_normal((150, 150)))[0]
    e = np.concatenate([np.full(10, 5.0), np.full(9, 3.0), rng.uniform(0, 2, 131)])
    v = q * e @ q.T
    values, vectors, residual = whitening.eigenpairs(lambda t: v @ t, 150)
    assert np.allclose(values, [5.0] * 10 + [3.0] * 6, rtol=1e-11)
    assert np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12) and residual < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 3))
    b[:, 1] = 0
    x = whitening.minres(lambda t: a @ t, b, steps=90, rough=1e-11)
    assert np.allclose(a @ x, b, atol=1e-7)
    # stopped early, the residual is the least over the Krylov space
    x = whitening.minres(lambda t: a @ t, b[:, :1], steps=4, rough=0)
    krylov = np.hstack([np.linalg.matrix_power(a, i) @ b[:, :1] for i in range(4)])
    best = np.linalg.lstsq(a @ krylov, b[:, 0], rcond=None)
    assert np.linalg.norm(a @ x - b[:, :1]) == pytest.approx(math.sqrt(best[1][0]), rel=1e-8)


def test_product_is_distributed_and_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 12))
    df = spark.createDataFrame(list(enumerate(floats(x))), "vec_id long, embedding array<float>").repartition(7)
    rows = whitening.grid_rows(df)
    fit = whitening.FitList(rows, 12)
    grid = np.floor(64 * np.float32(x).astype(float)) + 1_000_000
    centred = grid - grid.mean(axis=0)
    t = rng.standard_normal((12, 5))
    assert fit.n == 500 and fit.sums == grid.sum(axis=0).astype(int).tolist()
    assert np.allclose(fit.product(t), centred.T @ (centred @ t) / 500, rtol=1e-10)
    assert fit.trace() == pytest.approx((centred ** 2).sum() / 500, rel=1e-12)
