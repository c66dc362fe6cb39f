"""Top-k against all scores by numpy."""

import numpy as np
import pytest

from facetra.llm.top_k import exact_top_k, scaled


def brute(rows, queries, k):
    ok = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows}
    out = set()
    for q in queries:
        scores = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("lists", [1, 3, 4])
@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_random(spark, lists, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=10) * scale).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(15)]  # ties
    v = scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = exact_top_k(v, v.filter("id % 10 = 0"), 4, lists, queries_at_once=5)
    want = brute(rows, [i for i, _ in rows if i % 10 == 0], 4)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1), (5, [0.5, -1.0], 1), (6, [], 1), (7, [1.0], 1)]
    v = scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"))
    assert sorted(r.id for r in v.collect()) == [0, 0, 5, 6, 7]
    got = exact_top_k(v, v.filter("id = 0"), 5).collect()
    own, other = (0, 1, 0, 256 * 256 + 512 * 512), (0, 2, 5, 256 * 128 - 512 * 256)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [own, own, other, other]  # either row of id 0
    assert exact_top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 2.0]), (0, [5.0, 5.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])]
    v = scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r["rank"], r.vec_id, r.score >> 16) for r in exact_top_k(v, v.filter("id = 0"), 2).collect()}
    assert got == {(0, 1, 0, 15), (0, 2, 1, 3), (0, 2, 2, 15)}  # (0, 1, 0) for both rows of id 0
    (best,) = exact_top_k(v, v.filter("id = 1"), 1).collect()
    assert (best.vec_id, best.score) == (0, 10 * 65536)
