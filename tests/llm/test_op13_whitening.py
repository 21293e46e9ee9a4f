"""Whitening against a dense eigensolver, and the qd solver alone."""

import math

import numpy as np
import pytest

from erario.llm import whitening

RNG = np.random.default_rng(3)


def orthogonal(n):
    return np.linalg.qr(RNG.normal(size=(n, n)))[0]


MATRICES = {
    "random": RNG.normal(size=(200, 40)), "graded": RNG.normal(size=(80, 40)) * np.logspace(0, -8, 40), "repeated": orthogonal(40) * 3,
    "deficient": RNG.normal(size=(50, 7)) @ RNG.normal(size=(7, 30)), "zero columns": np.c_[RNG.normal(size=(50, 5)), np.zeros((50, 4)), RNG.normal(size=(50, 3))],
    "diagonal": np.diag([5.0, 5, 5, 1, 1, 0.1]), "one": np.array([[3.0]]), "two": RNG.normal(size=(2, 2)),
    "cluster": orthogonal(48) @ np.diag(1 + 1e-9 * np.arange(48)) @ orthogonal(48), "more columns than rows": RNG.normal(size=(6, 20)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_principal_values_and_vectors(name):
    m = MATRICES[name]
    values, axes, trace = whitening.principal(whitening.triangle(m), 32)
    squares = np.linalg.svd(m, compute_uv=False) ** 2
    rank = min(32, int((squares > squares[0] * 1e-24).sum()))
    assert len(values) == rank
    assert np.allclose(values, squares[:rank], rtol=1e-12, atol=1e-15 * squares[0])
    assert abs(trace - squares.sum()) < 1e-13 * squares.sum()
    assert np.abs(axes.T @ axes - np.eye(rank)).max() < 1e-11
    assert np.abs(m.T @ (m @ axes) - axes * values).max() < 1e-11 * squares[0]


def test_small_values_keep_their_relative_accuracy():
    # over 18 orders of magnitude; the product of all values is the determinant
    diagonal, upper = np.logspace(0, -18, 12), np.logspace(-1, -19, 12)[:-1]
    found = whitening.dqds(diagonal, upper)
    assert np.prod(found / np.sort(diagonal**2)[::-1]) == pytest.approx(1, rel=1e-12)


def brute(rows):
    good = [(i, v) for i, v in rows if v and len(v) == len(rows[0][1]) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return good, n, deviation, centred, values[::-1], axes[:, ::-1]


def test_rows_against_a_dense_solver(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=40) * np.linspace(1, 4, 40)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(900, None), (901, []), (902, [None] * 40), (903, [math.nan] * 40), (904, [math.inf] * 40), (905, [1.0] * 3), (7, rows[7][1]), (None, rows[8][1])]
    df = spark.createDataFrame([(i, v, 5, "n") for i, v in rows], "vec_id long, embedding array<float>, component int, at string").repartition(9)
    got = whitening.whiten(df).collect()
    good, n, deviation, centred, values, axes = brute(rows)
    assert len(got) == len(good) * 32 and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    for c in range(32):
        expected = centred @ axes[:, c] / math.sqrt(values[c])
        sign = np.sign(by[c + 1][good[0][0]][0].whitened * expected[0])
        for (i, _), d, w in zip(good, deviation, expected):
            for r in by[c + 1][i]:
                assert r.deviation == d and abs(sign * r.whitened - w) < 1e-8 and abs(r.explained - values[c] / values.sum()) < 1e-12
    assert max(r.identity_error for r in got) < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3])
def test_nothing_to_scale_by_gives_no_row(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


def test_entries_beyond_a_long_have_a_defined_result(spark):
    rows = [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert got and all(r.deviation is None for r in got)


def test_exact_integers():
    x = np.array([[5, 7], [9, -3]])
    assert whitening.deviations(x, 2, np.array([14, 4], object)).tolist() == [[-4, 10], [4, -10]]
    large = np.array([[1 << 61, 0]])
    assert whitening.deviations(large, 4, np.array([3, 0], object)).tolist() == [[(1 << 63) - 3, 0]]
    assert whitening.squares(np.array([[3, 4]])) == [25]
    assert whitening.squares(np.array([[1 << 40, 0], [1, 1]])) == [None, 2]
