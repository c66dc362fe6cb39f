"""Whitening against numpy with whole-number sums."""

import numpy as np
import pytest

from facetra.llm import whitening
from facetra.llm.whitening import whiten


def brute(vectors, components):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n = len(x)
    gap = n * x - x.sum(axis=0)
    c = gap / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return (gap**2).sum(axis=1), c @ u[:, :components] / np.sqrt(e[:components]), e[:components] / np.trace(v)


def tables(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    return got


@pytest.mark.parametrize("slab", [16_384, 1])
def test_random(spark, monkeypatch, slab):
    monkeypatch.setattr(whitening, "SLAB", slab)
    monkeypatch.setattr(whitening, "BLOCK", 64)
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)) @ rng.normal(size=(12, 12))
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    deviation, w, explained = brute(v.astype(np.float32), 8)
    got = tables(whiten(df))
    assert len(got) == 300 and all(set(r) == set(range(1, 9)) for r in got.values())
    found = np.array([[got[i][j].whitened for j in range(1, 9)] for i in range(300)])
    assert [got[i][1].deviation for i in range(300)] == deviation.tolist()
    sign = np.sign((found * w).sum(axis=0))
    assert np.abs(found * sign - w).max() < 1e-9
    assert np.allclose([got[0][j].explained for j in range(1, 9)], explained, rtol=1e-10)
    errors = {r.identity_error for rows in got.values() for r in rows.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.5], 7), (1, [0.1, 0.5], 7), (None, [0.9, -0.5], 7), (2, [0.2, 0.7], 7)]
    bad = [(3, None, 7), (4, [None, 1.0], 7), (5, [nan, 1.0], 7), (6, [inf, 0.0], 7), (7, [], 7), (8, [1.0], 7)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, component int").withColumnsRenamed({})
    rows = whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in rows) == sorted(
        [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 2, 1), (False, 2, 2), (True, 0, 1), (True, 0, 2)]
    )
    assert {r.n for r in rows} == {4}
    deviation, w, _ = brute([v for _, v, _ in good], 2)
    assert {r.deviation for r in rows} == set(deviation.tolist())
    one = [abs(r.whitened) for r in rows if r.vec_id is None and r.component == 1]
    assert one == pytest.approx([abs(w[2, 0])], abs=1e-9)
    assert whiten(df.limit(0)).count() == 0
    assert whiten(df.filter("vec_id = 3")).count() == 0


def test_no_spread(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    rows = whiten(df).collect()
    assert len(rows) == 4
    assert {(r.deviation, r.whitened, r.identity_error) for r in rows} == {(0, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = whiten(line).collect()
    assert {r.whitened is None for r in rows if r.component == 2} == {True}
    assert all(r.explained == pytest.approx(1.0) for r in rows if r.component == 1)
    huge = spark.createDataFrame([(1, [1e12]), (2, [-1e12])], "vec_id long, embedding array<double>")
    assert {(r.deviation, round(abs(r.whitened), 9)) for r in whiten(huge).collect()} == {(None, 1.0)}
