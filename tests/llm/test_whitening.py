"""Whitening against exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelane.llm import whitening
from kinelane.llm.whitening import scatter, whiten


@pytest.mark.parametrize("n, size, most", [(1, 3, 5), (7, 4, 50), (130, 5, 2**40), (300, 3, 2**62), (70, 6, 0)])
def test_scatter_is_exact(n, size, most):
    rng = np.random.default_rng(n)
    x = rng.integers(-most, most + 1, (n, size)) if most else np.full((n, size), 9)
    whole = np.concatenate([np.ones((n, 1), object), x.astype(object)], axis=1)
    assert (scatter(x) == whole.T.dot(whole)).all()


def _table(spark, rows, ids=None):
    ids = range(len(rows)) if ids is None else ids
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit(3) for c in ("id", "n", "i", "size", "component", "whitened")}).repartition(3)


def _check(found, vectors, components=32):
    """Every column from exact covariances; whitened values by their definition on the components found."""
    x = [[math.floor(64 * c) + 1_000_000 for c in np.array(v, np.float32).astype(float).tolist()] for _, v in vectors]
    n, size = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    v = [[Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n) for j in range(size)] for i in range(size)]
    trace = sum(v[i][i] for i in range(size))
    assert len(found) == n * min(size, components) and {r["n"] for r in found} == {n}
    deviation = {k: sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for (k, _), r in zip(vectors, x, strict=True)}
    assert all(int(r["deviation"]) == deviation[r["vec_id"]] for r in found)
    assert len({r["identity_error"] for r in found}) <= 1 and found[0]["identity_error"] < 1e-6
    values = np.linalg.eigvalsh(np.array([[float(a / trace) if trace else 0.0 for a in row] for row in v]))[::-1]
    for k in range(min(size, components)):
        own = [r for r in found if r["component"] == k + 1]
        assert len({r["explained"] for r in own}) == 1
        if values[k] > 1e-10:
            assert own[0]["explained"] == pytest.approx(values[k], rel=1e-6)
    return x


def test_rows_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(rng.normal(size=6) * [1, 5, 0.1, 2, 1, 1]).astype(np.float32).tolist() for _ in range(90)]
    good[5] = good[4]
    odd = [None, [], [1.0] * 5, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    found = whiten(_table(spark, good + odd)).collect()
    x = np.array(_check(found, list(enumerate(good))), float)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    want = np.abs((x - x.mean(axis=0)) @ vectors / np.sqrt(values))[:, ::-1]
    got = np.zeros_like(want)
    for r in found:
        got[r["vec_id"], r["component"] - 1] = abs(r["whitened"])
    assert np.allclose(got, want, atol=1e-8)


def test_more_dimensions_than_components(spark):
    rows = np.random.default_rng(4).normal(size=(80, 40)).astype(np.float32).tolist()
    _check(whiten(_table(spark, rows)).collect(), list(enumerate(rows)))


def test_outlier_keeps_the_small_components(spark):
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=5).astype(np.float32).tolist() for _ in range(200)]
    rows[7][2] = 3e9
    found = whiten(_table(spark, rows)).collect()
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows], dtype=object)
    rest = np.array([r for k, r in enumerate(x) if k != 7], float)
    _, *small = sorted({(r["component"], r["explained"]) for r in found})
    trace = float(200 * (x[:, 2] ** 2).sum() - x[:, 2].sum() ** 2) / 200**2
    shape = np.cov(rest.T, bias=True)
    bounds = np.linalg.eigvalsh(np.delete(np.delete(shape, 2, 0), 2, 1))[::-1]
    for (_, explained), bound in zip(small, bounds, strict=True):
        assert explained * trace == pytest.approx(bound, rel=0.1)
    assert found[0]["identity_error"] < 1e-4


def test_huge_values_and_no_variance(spark):
    rows = [[1e30, 1.0, 2.0], [-1e30, 1.0, 3.0], [0.0, 1.0, 4.0], [0.0, 1.0, 4.5]]
    found = whiten(_table(spark, rows)).collect()
    flat = [r for r in found if r["component"] == 3]
    assert all(r["whitened"] is None and r["explained"] == 0 for r in flat) and found[0]["identity_error"] < 1e-4
    same = whiten(_table(spark, [[1.0, 2.0]] * 3)).collect()
    assert all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in same) and len(same) == 6


def test_null_repeated_and_no_rows(spark):
    found = whiten(_table(spark, [[1.0, 2.0], [1.0, 2.0], [3.0, -1.0]], [None, 4, 4]))
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found.collect()) == [(0, 1), (0, 2), (4, 1), (4, 1), (4, 2), (4, 2)]
    assert whiten(_table(spark, [[1.0]]).limit(0)).count() == 0 and whiten(_table(spark, [None, []])).count() == 0


def test_blocks(spark, monkeypatch):
    rows = np.random.default_rng(6).normal(size=(50, 4)).astype(np.float32).tolist()
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 20)
    _check(whiten(_table(spark, rows)).collect(), list(enumerate(rows)))
