"""Whitening against exact sums, library eigenvectors and worked cases."""

import math

import numpy as np
import pytest

from studyspark.llm.whitening import Totals, deviations, leading_components, leading_values, sturm_counts, tridiagonal, whiten


def _symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("values", [
    np.arange(1, 41) ** 2, [5] * 12, [9, 9, 9, 4, 4, 1, 1, 1, 1, 0, 0, 0], [1e9, 1e9 - 1e-3, 3, 2, 1e-6, 0, 0], [3], [2, 1], [0, 0, 0], [7, 7 - 1e-9, 7 - 2e-9, 1, 1]])
def test_components_equal_library(values):
    a = _symmetric(values)
    a = (a + a.T) / 2
    d, e, q = tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.allclose(q @ t @ q.T, a, atol=1e-13 * scale) and np.allclose(q.T @ q, np.eye(len(a)), atol=1e-13)
    found, vectors = leading_components(a, 8)
    k = min(8, len(a))
    assert np.allclose(found, np.sort(values)[::-1][:k], atol=1e-13 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-12 * scale


def test_diagonal_and_split_matrices():
    for a in (np.diag([3.0, 1.0, 2.0, 2.0]), np.kron(np.eye(3), np.array([[2.0, 1.0], [1.0, 2.0]]))):
        found, vectors = leading_components(a, 8)
        assert np.allclose(found, np.sort(np.linalg.eigvalsh(a))[::-1]) and np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * found, atol=1e-12)


def test_sturm_counts():
    d, e, _ = tridiagonal(_symmetric([1, 2, 3, 4, 5]))
    assert sturm_counts(d, e, np.array([0.5, 1.5, 3.5, 9.0])).tolist() == [0, 1, 3, 5]
    assert np.allclose(leading_values(d, e, 2), [5, 4], atol=1e-14)


def _brute(vectors):
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    values, basis = np.linalg.eigh(np.cov(np.array(x, float).T, bias=True).reshape(len(s), len(s)))
    order = np.argsort(-values)[:8]
    w = (np.array(x, float) - np.array(s) / n) @ basis[:, order]
    return n, [sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x], values[order], values.sum(), w


def test_whitened_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((300, 12)) * np.arange(1, 13) * 0.2).astype(np.float32)
    good = np.concatenate([good, good[:40], np.tile(good[0], (90, 1))])       # repeated vectors and a hot one
    rows = [(i, v.tolist(), "x", 1.0) for i, v in enumerate(good)]
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [1.0] * 11 + [float("nan")]), (903, [float("inf")] * 12), (904, []), (905, [1.0]), (906, [1e30] * 12)]
    table = spark.createDataFrame(rows + [(i, v, None, None) for i, v in odd], "vec_id long, embedding array<float>, whitened string, n double").repartition(7)
    got = whiten(table).collect()
    n, deviation, values, trace, w = _brute(good.astype(float))
    assert len(got) == 8 * n and {r.vec_id for r in got} == set(range(n)) and {r.n for r in got} == {n}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    assert all(abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9 for r in got) and max(r.identity_error for r in got) < 1e-9
    mine = np.zeros((n, 8))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
    other = w / np.sqrt(values)
    assert np.allclose(mine * np.sign((mine * other).sum(axis=0)), other, atol=1e-8)
    twice = whiten(table.union(table)).collect()
    assert len(twice) == 16 * n and {r.n for r in twice} == {2 * n}


def test_no_rows_and_no_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
    one = whiten(spark.createDataFrame([(1, [0.5, -0.5, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)]
    flat = whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (None, [3.0, 5.0])], schema)).collect()
    first = sorted(r.whitened for r in flat if r.component == 1)
    assert np.allclose(first, [-1.5 ** 0.5, 0, 1.5 ** 0.5]) and all(r.whitened is None for r in flat if r.component == 2) and flat[0].identity_error < 1e-12


def test_deviations_beyond_64_bits():
    x = np.array([[3, 4], [1 << 53, 0]])
    of = Totals(1 << 20, (5 << 20, 1 << 20))
    assert deviations(x, of).to_pylist() == [((3 - 5) ** 2 + 9) << 40, None]
