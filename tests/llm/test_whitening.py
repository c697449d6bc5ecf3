"""Embedding whitening (11) against numpy's eigenvectors, and its edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvane.llm import qd, whitening


def gram(a):
    return a.T @ a


@pytest.mark.parametrize("kind", ["plain", "graded", "close", "equal", "copies", "low rank", "wide", "zero",
                                  "one column"])
def test_qd_finds_eigenpairs(kind):
    rng = np.random.default_rng(5)
    a = {"plain": rng.normal(size=(300, 40)), "graded": rng.normal(size=(300, 40)) * np.logspace(0, -6, 40),
         "close": np.linalg.qr(rng.normal(size=(300, 30)))[0] * (1 + 1e-9 * rng.normal(size=30)),
         "equal": np.vstack([np.eye(12), -np.eye(12)]), "copies": np.hstack([rng.normal(size=(50, 4))] * 3),
         "low rank": rng.normal(size=(90, 6)) @ rng.normal(size=(6, 40)),
         "wide": rng.normal(size=(5, 20)), "zero": np.zeros((3, 4)),
         "one column": rng.normal(size=(9, 1))}[kind]
    r = np.zeros((a.shape[1],) * 2)
    q = np.linalg.qr(a, mode="r")
    r[:len(q)] = q
    values, vectors = qd.leading(r, 10**6)
    assert len(values) == np.linalg.matrix_rank(a)
    if len(values):
        top = values[0]
        assert np.all(np.diff(values) <= 0)
        assert np.abs(values - np.linalg.eigvalsh(gram(a))[::-1][:len(values)]).max() < 1e-13 * top
        assert np.abs(gram(a) @ vectors - vectors * values).max() < 1e-13 * top
        assert np.abs(gram(vectors) - np.eye(len(values))).max() < 1e-11


def test_bidiagonal_keeps_singular_values():
    a = np.triu(np.random.default_rng(1).normal(size=(9, 9)))
    d, e, v = qd.bidiagonal(a)
    b = np.diag(d) + np.diag(e, 1)
    assert np.allclose(gram(b), v.T @ gram(a) @ v)
    assert np.allclose(qd.gram_eigenvalues(d, e), np.linalg.svd(a, compute_uv=False) ** 2)


def plain(rows, most=16):
    """vec_id -> (n, deviation), whitened rows and explained shares, all by numpy and exact integers."""
    kept = [(i, [int(np.floor(64.0 * c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    once = sorted({tuple(x) for _, x in kept})
    n, sums = len(once), [sum(c) for c in zip(*once)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in kept]
    x, f = np.array([x for _, x in kept], float), np.array(once, float)
    mean = f.mean(axis=0)
    cov = gram(f - mean) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return kept, n, dev, (x - mean) @ u / np.sqrt(e), e / np.trace(cov)


def test_rows_match_plain_version_over_many_partitions(spark):
    rng = np.random.default_rng(8)
    base = (rng.normal(size=(700, 20)) * np.linspace(3, 1, 20)).astype("float32")
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]                  # a hot vector
    rows += [(2000, None), (2001, [float("nan")] + [0.0] * 19), (2002, [None] + [0.0] * 19),
             (2003, [float("-inf")] * 20), (None, rows[1][1]), (None, None)]
    df = spark.createDataFrame([(i, v, "x", 1, 2, 3.0) for i, v in rows],
                               "vec_id long, embedding array<float>, id string, x int, n int, deviation double")
    got = whitening.report(df.repartition(150)).collect()
    kept, n, dev, white, explained = plain(rows)
    assert len(got) == 16 * len(kept) and {r.n for r in got} == {n} == {700}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    for (i, _), d, w in zip(kept, dev, white):
        mine = by_id[i]
        assert sorted(mine) == list(range(1, 17))
        for k in range(16):
            r = mine[k + 1]
            assert r.deviation == d and abs(r.explained - explained[k]) < 1e-9
            if abs(w[k]) > 1e-3:
                sign.setdefault(k, np.sign(r.whitened * w[k]))
            assert abs(r.whitened * sign.get(k, 1) - w[k]) < 1e-7


def test_rounds_of_folding(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FOLD", 3)
    x = np.random.default_rng(2).integers(0, 50, size=(200, 6))
    rows = spark.createDataFrame([([int(c) for c in v],) for v in x], "x array<long>").repartition(40)
    mean = whitening.moments(rows)
    r = whitening.triangle(rows, mean)
    f = x - x.mean(axis=0)
    assert np.allclose(gram(r), gram(f))
    e, u = np.linalg.eigh(gram(f) / 200)
    assert whitening.identity_error(rows, mean, u / np.sqrt(e)) < 1e-10
    assert abs(whitening.identity_error(rows, mean, 2 * u / np.sqrt(e)) - 3) < 1e-9


def test_moments_beyond_long():
    big = whitening.Moments(10**9, [10**9 * (1 << 40)], 1 << 41)
    x = np.array([[1 << 40], [(1 << 40) + 3], [1 << 41]])
    assert big.deviation(x)[:2] == [0, 9 * 10**18]
    assert big.deviation(x)[2] is None
    assert np.allclose(big.centred(x).ravel(), [0, 3, 1 << 40])


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert whitening.report(frame([])).count() == 0
    assert whitening.report(frame([(1, None), (2, [])])).count() == 0
    assert whitening.report(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0       # one vector
    two = whitening.report(frame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [5.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in two) == \
        [(1, 1, 2, 4096), (2, 1, 2, 4096)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == pytest.approx(1) for r in two)
    ties = whitening.report(frame([(i, [float(i == j) - float(i == j + 4) for j in range(4)])
                                   for i in range(8)]))
    assert ties.select("explained").distinct().count() <= 4 and ties.count() == 32
    assert ties.agg(F.max("identity_error")).first()[0] < 1e-12
