"""Embedding whitening against numpy and exact arithmetic on small tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tonguemill.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n string"


def got(spark, vectors, **kw):
    df = spark.createDataFrame([(i, v, 0, "x", "n") for i, v in enumerate(vectors)], SCHEMA)
    told = whitening.whiten_vectors(df, **kw)
    assert told.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return told.collect()


def check(rows, kept, most=16):
    """rows are those of the vectors kept {id: list}, up to repeated ids."""
    x = {i: np.array([math.floor(64 * c) + 1_000_000 for c in v]) for i, v in kept.items()}
    fit = np.array(sorted({tuple(v.tolist()) for v in x.values()}), object)
    n, s = len(fit), fit.sum(0)
    scatter = np.array([[sum(int(a) * int(b) for a, b in zip(fit[:, i], fit[:, j])) * n - int(s[i]) * int(s[j]) for j in range(len(s))] for i in range(len(s))], object)
    value, vector = np.linalg.eigh(scatter.astype(float) / n**2)
    value, vector = value[::-1], vector[:, ::-1]
    m = min(most, int((value > 1e-9 * value[0]).sum()))
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((i, k + 1) for i in x for k in range(m))
    white = {}
    for r in rows:
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], s))
        assert r.n == n and r.deviation == (deviation if deviation < 2**63 else None)
        assert r.explained == pytest.approx(value[r.component - 1] / value.sum(), rel=1e-9) and r.identity_error < 1e-9
        white[r.vec_id, r.component - 1] = r.whitened
    ids = list(x)
    centred = np.array([[float(Fraction(int(a) * n - int(b), n)) for a, b in zip(x[i], s)] for i in ids])
    own = np.array([[white[i, k] for k in range(m)] for i in ids])
    # equal eigenvalues leave the basis open, so whole eigenspaces are compared by inner products
    close = [0, *(np.flatnonzero(value[: m - 1] - value[1:m] > 1e-7 * value[0]) + 1).tolist(), m]
    for a, b in zip(close, close[1:]):
        if b == m and m < len(value) and value[m - 1] - value[m] < 1e-7 * value[0]:
            continue  # cut through an eigenspace
        p = centred @ vector[:, a:b] / np.sqrt(value[a:b])
        assert np.allclose(own[:, a:b] @ own[:, a:b].T, p @ p.T, atol=1e-8)
    first = {tuple(x[i].tolist()): j for j, i in enumerate(ids)}
    w = own[sorted(first.values())]
    assert np.abs((w - w.mean(0)).T @ (w - w.mean(0)) / n - np.eye(m)).max() < 1e-8


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = (rng.normal(size=(60, 20)) @ rng.normal(size=(20, 20))).tolist()
    odd = [None, [], [1.0, None] + [0.0] * 18, [float("nan")] * 20, [float("inf")] * 20, [1e300] * 20, [1.0] * 19, [1.0] * 21]
    rows = got(spark, [*good, good[0], good[0], *odd])
    check(rows, dict(enumerate([*good, good[0], good[0]])))
    assert got(spark, []) == [] and got(spark, odd[:5]) == [] and got(spark, [[1.0, 2.0]] * 5) == []


def test_whitening_of_equal_and_zero_eigenvalues(spark):
    # a cross: every direction alike; the last entry never varies
    cross = [[s if i == k else 0.0 for i in range(5)] + [7.0] for k in range(5) for s in (-1.0, 1.0)]
    check(got(spark, cross), dict(enumerate(cross)))
    line = [[float(i), 2.0 * i, -3.0 * i] for i in range(9)]
    rows = got(spark, line)
    check(rows, dict(enumerate(line)))
    assert {r.component for r in rows} == {1} and rows[0].explained == 1.0


def test_whitening_of_close_and_large_values(spark):
    rng = np.random.default_rng(4)
    big = (rng.normal(size=(40, 6)) * [1e6, 1e6, 1e3, 1, 1, 0.1]).tolist()
    check(got(spark, big, components=3), dict(enumerate(big)), 3)
    huge = got(spark, [[1e9, 0.0], [-1e9, 1.0], [5.0, 2.0]])
    assert {r.deviation for r in huge} == {None} or all(r.deviation is None or r.deviation >= 0 for r in huge)


def exact_polynomial(c):
    """By Faddeev and LeVerrier, lowest power first."""
    d, m, out = len(c), np.zeros_like(c), [1]
    for k in range(1, d + 1):
        m = c @ m + out[-1] * np.array(np.eye(d, dtype=int).tolist(), object)
        out.append(-int(np.trace(c @ m)) // k)
    return out[::-1]


def test_polynomial_and_roots_are_exact():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 9):
        a = rng.integers(-9, 9, (d, max(1, d - 2)))
        c = np.array((a @ a.T).tolist(), object)
        moduli = whitening.primes(10**30)
        poly = whitening.combined({p: whitening.polynomial_modulo(c, p) for p in moduli})
        assert poly == exact_polynomial(c)
        value = np.linalg.eigvalsh(c.astype(float))[::-1]
        for k in range(1, d + 1):
            low, above, here = whitening.isolated(poly, k, 64)
            assert abs(low / 2**64 - value[k - 1]) < 1e-8 * max(1, value[0]) and above < k <= above + here
    # (x - 3)**2 (x - 5) x
    poly = np.polynomial.polynomial.polyfromroots([3, 3, 5, 0]).astype(int).tolist()
    assert [whitening.isolated(poly, k, 8)[1:] for k in (1, 2, 3, 4)] == [(0, 1), (1, 2), (1, 2), (3, 1)]
    assert [whitening.roots_above(poly, t) for t in (-1, 0, 2, 3, 5)] == [4, 3, 3, 1, 0]


def test_whitening_query(spark, data):
    rows = registry.QUERIES["op13_embedding_whitening"](spark, data).collect()
    kept = {r.vec_id: r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    check(rows, kept)
