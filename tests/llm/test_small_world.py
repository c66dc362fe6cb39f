"""Links and components against all cosines."""

import numpy as np
import pytest

from facetra.llm.small_world import _roots, _unit, build, linked, near_duplicates

SHAPE = "vec_id long, embedding array<double>, label int, first long, id string"


def clustered(rng, n, groups, dims=16, noise=0.06):
    x = rng.normal(size=(n, dims))
    for size in groups:
        at = rng.choice(n, size, replace=False)
        x[at] = x[at[0]] + noise * rng.normal(size=(size, dims)) * np.linalg.norm(x[at[0]]) / np.sqrt(dims) * 4
    return x


def truth(x, least):
    u = _unit(x)
    t = u @ u.T >= least
    np.fill_diagonal(t, False)
    return u, t


@pytest.mark.parametrize("groups", [[], [30, 10, 5], [600]])
def test_links_of_a_shard(groups):
    x = clustered(np.random.default_rng(1), 1500, groups)
    u, want = truth(x, 0.93)
    found = linked(build(u.astype(np.float32)), u, u, 0.93, own=True)
    assert not (found & ~want).any()
    assert found.sum() >= 0.9 * want.sum()


@pytest.mark.parametrize("own", [True, False])
def test_few_links_are_not_passed_unchecked(own):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 16))
    audited = np.random.default_rng(3).permutation(1200 if own else 600)[:128]
    at = np.setdiff1d(np.arange(600), [audited, audited - 600])[:20]  # no link has an end in the sample
    x[600 + at] = x[at] + 1e-3 * rng.normal(size=(20, 16))
    u = _unit(x)
    exact, queries = (u, u) if own else (u[:600], u[600:])
    g = build(exact.astype(np.float32))
    g.layers = [np.full_like(layer, -1) for layer in g.layers]  # a graph that finds nothing
    want = queries @ exact.T >= 0.93
    if own:
        np.fill_diagonal(want, False)
    assert want.sum() >= 20
    assert (linked(g, exact, queries, 0.93, own=own) == want).all()


def test_searched_blocks_are_not_compared_as_a_whole(monkeypatch):
    def never(*_):
        raise AssertionError("compared as a whole")

    monkeypatch.setattr("facetra.llm.small_world._compared", never)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64))
    x[1500:1540] = x[:40] + 0.02 * rng.normal(size=(40, 64))  # few links, between and within halves
    x[100:140] = x[200:240] + 0.02 * rng.normal(size=(40, 64))
    u = _unit(x)
    for exact, queries in ((u, u), (u[:1500], u[1500:])):
        own = exact is queries
        back = None if own else build(queries.astype(np.float32))
        found = linked(build(exact.astype(np.float32)), exact, queries, 0.93, own=own, back=back)
        want = queries @ exact.T >= 0.93
        if own:
            np.fill_diagonal(want, False)
        assert want.sum() >= 40 and not (found & ~want).any() and (found & want).sum() >= 0.99 * want.sum()


def test_both_ways():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(4, 16))
    u = _unit(base[rng.integers(0, 4, 800)] + 0.05 * rng.normal(size=(800, 16)))
    exact, queries = u[:400], u[400:]
    g, back = build(exact.astype(np.float32)), build(queries.astype(np.float32))
    found = linked(g, exact, queries, 0.93, own=False, back=back)
    want = queries @ exact.T >= 0.93
    assert not (found & ~want).any() and (found & want).sum() >= 0.99 * want.sum()


def test_index_recall_of_nearest():
    x = np.random.default_rng(2).normal(size=(3000, 16))
    u = _unit(x).astype(np.float32)
    g = build(u)
    ids, _ = g.search(u[:200], 64)
    best = np.argsort(-(u[:200] @ u.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), best.tolist())]) >= 0.9


def test_tiny_graphs():
    for n in (0, 1, 2, 5):
        u = _unit(np.random.default_rng(n).normal(size=(n, 4))) if n else np.zeros((0, 4))
        g = build(u.astype(np.float32))
        if n:
            assert linked(g, u, u, 0.93, own=True).shape == (n, n)
    assert _roots(4, np.array([3, 1]), np.array([1, 2])).tolist() == [0, 1, 1, 1]


@pytest.mark.parametrize("shard", [8192, 60])
def test_against_all_cosines(spark, shard):
    rng = np.random.default_rng(4)
    x = clustered(rng, 300, [40, 12])
    x[250:] = x[0]  # exact copies
    label = rng.integers(0, 2, 300)
    rows = [(i, v.tolist(), int(k), None, None) for i, (v, k) in enumerate(zip(x, label))]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(3), shard=shard).collect()}
    _, want = truth(x, 0.93)
    want &= label[:, None] == label[None, :]
    root = _roots(300, *np.nonzero(want))
    assert all(got[i].n_links == want[i].sum() and got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in range(300))


def test_odd_rows(spark):
    nan = float("nan")
    v = [1.0, 2.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0], 1), (4, v, None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (None, v, 1), (10, [1.0, 2.0, 0.0], 1), (11, v, 2), (12, [1e300, 2e300], 1)]
    got = near_duplicates(spark.createDataFrame([(*r, None, None) for r in rows], SHAPE)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == sorted(
        [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (12, 4, 1, False)]
        + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)] + [(0, 0, 0, True)]
    )
    assert near_duplicates(spark.createDataFrame([], SHAPE)).count() == 0
