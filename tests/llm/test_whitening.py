"""Whitening against plain double and rational arithmetic, and the refinement on matrices of known eigenvalues."""

from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def orthogonal(rng, n):
    q = np.linalg.qr(rng.normal(size=(n, n)))[0].astype(np.longdouble)
    return q + q @ (np.eye(n) - q.T @ q) / 2


@pytest.mark.parametrize("values", [np.arange(1.0, 41), np.r_[np.ones(9), np.arange(2.0, 20)], np.r_[1 + 1e-9 * np.arange(8), np.arange(2.0, 30)], np.ones(5), np.r_[np.zeros(3), 1, 2], 10.0 ** -np.arange(12)], ids=["apart", "equal", "close", "one", "zero", "wide"])
def test_refined_vectors_are_eigenvectors(values):
    q = orthogonal(np.random.default_rng(3), len(values))
    v = ((q * values) @ q.T).astype(np.float64)
    v = (v + v.T) / 2
    found, x = whitening.refined_eigen(v)
    x = x.astype(np.longdouble)
    top = values.max()
    assert (np.diff(found) <= 0).all() and np.abs(found - np.sort(values)[::-1]).max() < 1e-14 * top
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15 and np.abs(v @ x - x * found).max() < 1e-15 * top
    # Better than a double solve alone where eigenvalues are apart, and no float32 left in it.
    if np.array_equal(values, np.arange(1.0, 41)):
        assert np.abs(np.abs(x) - np.abs(q[:, ::-1])).max() < 1e-15


def test_clusters_are_solved_by_themselves():
    values = np.r_[1 + 1e-6 * np.arange(4), 50.0]
    q = orthogonal(np.random.default_rng(5), 5)
    v = ((q * values) @ q.T).astype(np.float64)
    x = np.linalg.eigh(v.astype(np.float32))[1].astype(np.float64)
    _, at, clusters, _ = whitening.corrected(v, x)
    assert len(clusters) == 1 and len(clusters[0]) == 4
    turned = whitening.solved_inside(v, x, at, clusters[0])
    small = turned.T @ (v @ turned)
    assert np.abs(small - np.diag(np.diag(small))).max() < 1e-11


def rows(n=300, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(dims, dims)) / 4
    return [(i, [float(np.float32(x)) for x in base @ rng.normal(size=dims)]) for i in range(n)]


def test_whitened_rows_equal_plain_arithmetic(spark):
    good = rows()
    repeats = [(1000 + i, good[7][1]) for i in range(200)] + [good[3], (None, good[4][1])]  # most rows are one vector
    bad = [(2000, None), (2001, []), (2002, [None] * 12), (2003, [float("nan")] * 12), (2004, [float("inf")] * 12), (2005, [1e30] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + repeats + bad], SCHEMA).selectExpr("*", "1 as v", "2 as e", "3 as id", "4 as n", "5 as dims")
    got = whitening.whiten(df, 5).orderBy("vec_id", "component").collect()
    kept = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in good + repeats]
    fit = sorted({tuple(v.tolist()) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    assert len(got) == 5 * len(kept) and {r.n for r in got} == {n} and n < len(kept)
    centred = np.array([[Fraction(x) - Fraction(s, n) for x, s in zip(v, sums, strict=True)] for v in fit])
    cov = np.array([[float(x) for x in line] for line in centred.T @ centred / n])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {}
    for i, v in kept:
        own = np.array([float(Fraction(int(x)) - Fraction(s, n)) for x, s in zip(v, sums, strict=True)])
        want.setdefault(i, (own @ vectors[:, :5] / np.sqrt(values[:5]), sum((n * int(x) - s) ** 2 for x, s in zip(v, sums, strict=True))))
    sign = {c: 1 if next(r for r in got if r.vec_id == 0 and r.component == c).whitened * want[0][0][c - 1] > 0 else -1 for c in range(1, 6)}
    for r in got:
        assert abs(r.whitened * sign[r.component] - want[r.vec_id][0][r.component - 1]) < 1e-10
        assert r.deviation == want[r.vec_id][1]
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-14 and 0 <= r.identity_error < 1e-12


def test_an_offset_changes_nothing_and_partitions_neither(spark):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows(80, 5)], SCHEMA)
    moved = df.selectExpr("vec_id", "transform(embedding, x -> cast(x as double) + 15625) as embedding", "label")
    key = lambda d: {(r.vec_id, r.component): (r.n, r.deviation, r.whitened, r.explained) for r in whitening.whiten(d, 3).collect()}
    assert key(df) == key(moved) == key(df.repartition(7))


def test_edges(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)], SCHEMA)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    # Lengths apart, components without variance left out, whatever the size of n * x.
    mixed = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0, 1.0], 1), (4, [0.0, 2.0, 0.0], 1), (5, [1.0, 0.0, 0.0], 1)], SCHEMA)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(mixed).collect()}
    assert sorted(got) == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 2)]
    assert got[1, 1].n == 2 and got[3, 1].n == 3 and abs(abs(got[1, 1].whitened) - 1) < 1e-15 and got[1, 1].explained == 1
    wide = whitening.Whitening(1, 10**6, [0], np.eye(1), np.ones(1), 1.0)
    assert wide.deviations(np.array([[1], [2**39]])) == [10**12, None]
