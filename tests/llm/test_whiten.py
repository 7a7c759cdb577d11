"""Whitening against a dense eigendecomposition, and block Lanczos on operators that are hard for it."""

from __future__ import annotations

import numpy as np
import pytest

from lumenforge.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def vectors(n, dim, seed, scale=None):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, dim)) * (scale if scale is not None else np.linspace(0.2, 2, dim))).astype(np.float32)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "n") for i, v in rows], SCHEMA)


def dense(m):
    """x of each row, the fit and its eigenpairs by numpy."""
    x = np.floor(64 * m.astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    values, columns = np.linalg.eigh(c.T @ c / n)
    return x, n, s, values[::-1], columns[:, ::-1]


@pytest.mark.parametrize(("n", "dim"), [(300, 24), (500, 96), (40, 10)])
def test_whitening_is_that_of_a_dense_decomposition(spark, n, dim):
    m = vectors(n, dim, dim)
    m[5] = m[4]
    out = whiten.whiten(table(spark, list(enumerate(m)))).toPandas()
    x, k, s, values, columns = dense(m)
    wanted = min(16, dim)
    assert len(out) == n * wanted and set(out["n"]) == {k}
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    true = ((k * x - s) / k) @ columns[:, :wanted] / np.sqrt(values[:wanted])
    signs = np.sign((w * true).sum(axis=0))
    assert np.abs(w * signs - true).max() < 1e-7
    explained = out.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, values[:wanted] / values.sum(), rtol=1e-9)
    assert out.groupby("vec_id")["deviation"].first().tolist() == [int(sum((k * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True))) for r in x]


def test_dropped_vectors_and_poor_ranks(spark):
    rows = [(0, None), (1, [None, 1.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, []), (5, [1.0, 2.0]), (6, [2.0, 4.0]), (6, [2.0, 4.0]), (None, [3.0, 6.0]), (7, [1.0, 1.0, 1.0])]
    out = whiten.whiten(table(spark, rows)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component, r.n) for r in out) == [(-1, 1, 3), (5, 1, 3), (6, 1, 3), (6, 1, 3)]  # one direction; the lone vector of three entries has none
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in out)
    assert whiten.whiten(table(spark, [])).collect() == []


@pytest.mark.parametrize("values", [np.r_[np.full(5, 7.0), np.linspace(0, 3, 115)], np.r_[1e6, 1e3, np.zeros(118)], np.full(120, 2.0), np.linspace(1, 1.01, 120)])
def test_block_lanczos_with_restarts_and_breakdowns(values):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((120, 120)))
    a = (q * values) @ q.T
    found, columns = whiten.block_lanczos(lambda b: a @ b, 120, 6, block=3, most=24)
    top = np.sort(values)[::-1]
    assert np.abs(found - top[:6]).max() <= 1e-9 * top[0]
    assert np.abs(columns.T @ columns - np.eye(6)).max() < 1e-10
    assert np.linalg.norm(a @ columns - columns * found, axis=0).max() < 1e-6 * top[0]
