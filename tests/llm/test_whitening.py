"""Whitening against a plain eigendecomposition, and its odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightbox.llm import whitening as wh

VECTORS = "vec_id long, embedding array<float>"


def whole(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def brute(rows, most=wh.COMPONENTS):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by numpy's eigh."""
    xs = [(i, whole(v)) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in xs}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = np.array([[float(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    out = {}
    for i, x in xs:
        off = [n * a - s for a, s in zip(x, sums)]
        for k in range(min(most, len(values))):
            e, u = values[-1 - k], vectors[:, -1 - k]
            out[i, k + 1] = (n, sum(o * o for o in off), abs(np.array([o / n for o in off], float) @ u) / math.sqrt(e), e / values.sum())
    return out


@pytest.mark.parametrize("size, width", [(300, 20), (40, 3), (500, 64)])
def test_whitening(spark, size, width):
    rng = np.random.default_rng(width)
    data = (rng.normal(size=(size, width)) @ rng.normal(size=(width, width)) * rng.uniform(0.01, 3, width)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(size + i, data[0].tolist()) for i in range(5)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(7)
    got = wh.whitened(frame, wh.train(frame)).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        n, deviation, size_, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - size_) < 1e-7 and abs(r.explained / explained - 1) < 1e-9
        assert r.identity_error < 1e-9
    # One sign per component, whatever the row.
    again = {(r.vec_id, r.component): r.whitened for r in wh.whitened(frame.coalesce(1), wh.train(frame)).collect()}
    for k in range(1, min(16, width) + 1):
        ratios = {round(again[r.vec_id, k] / r.whitened) for r in got if r.component == k and abs(r.whitened) > 1e-3}
        assert ratios in ({1}, {-1})


def test_factor_and_rotations():
    """The factor rebuilds the scatter, the rotated columns are orthogonal, ill-conditioned values keep their digits."""
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    scales = np.logspace(0, -5, 24)
    a = (q * scales) @ q.T
    lower, order = wh.pivoted_cholesky(a)
    assert np.allclose(lower @ lower.T, a[np.ix_(order, order)], atol=1e-15)
    assert np.all(np.triu(lower, 1) == 0) and np.all(np.diff(np.diagonal(lower)) <= 1e-12)
    vectors, values, trace = wh.components_of(a, 1, 24)
    assert np.allclose(values, scales, rtol=1e-9) and abs(trace - scales.sum()) < 1e-12
    assert np.allclose(vectors.T @ vectors, np.eye(24), atol=1e-12)
    assert sorted((int(i), int(j)) if i < j else (int(j), int(i)) for r in wh._rounds(7) for i, j in zip(*r)) == [
        (i, j) for i in range(7) for j in range(i + 1, 7)
    ]


def test_low_rank_and_lone_vectors(spark):
    """Directions without variance have no component."""
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], VECTORS)
    out = wh.whitened(flat, wh.train(flat)).collect()
    assert {r.component for r in out} == {1} and all(abs(r.explained - 1) < 1e-12 for r in out)
    lone = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)
    assert wh.train(lone) == {} and wh.whitened(lone, {}).count() == 0


def test_odd_rows(spark):
    """Nulls, non-finite and huge entries, several lengths, repeated and null identifiers, clashing columns."""
    rows = [
        (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [0.5, 1.0]),
        (6, [0.5, 1.0]), (6, [0.25, -1.0]), (7, [3.0, 2.0]), (8, [1.0]), (9, [2.0]), (10, [1.0, 2.0, 3.0]),
    ]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(c) for c in ("x", "n", "width", "kind", "component")})
    got = wh.whitened(frame, wh.train(frame)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted(
        [(i, k, 3) for i in ("None", "6", "6", "7") for k in (1, 2)] + [("8", 1, 2), ("9", 1, 2)]
    )
    empty = frame.limit(0)
    assert wh.train(empty) == {} and wh.whitened(empty, {}).count() == 0
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 5.0])], VECTORS)
    out = wh.whitened(huge, wh.train(huge)).collect()
    exact = sum(d * d for d in (3 * 64 - 64, 3 * 5 * 64 - 8 * 64))
    assert {(r.vec_id, r.deviation) for r in out} == {(1, None), (2, None), (3, exact)}
    assert all(math.isfinite(r.whitened) for r in out)
