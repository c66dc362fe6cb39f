"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors form a class first; only one member goes on. Classes of a label are dealt to
shards of bounded size by hash, and each shard builds its own graph in one task. Then every
shard is queried with the vectors of its own and of every other shard of the label; a task
holds two shards at a time, so a label of any size is searched in blocks.

A query walks down the layers and collects a beam of the best vertices on the lowest one.
Beams that hold links only are widened and searched again; two shards are searched both ways.
Audits compare with all vectors of the shard: probes, made from vectors of the shard by turning
them in a random direction until their cosine is just ``least``, so that there is always a true
link to find; a fixed sample of the queries; and a sample of those that found links. While one of
the three finds less than ``RECALL`` of its links, all beams of the block are widened, up to the
whole shard. Only blocks of at most ``WHOLE`` pairs, and graphs that leave vertices out of reach, are
compared as a whole. Links are verified by cosine in double precision.
Tasks return one row per vector (its number of links and one member of its component), never pairs.

All vertices of a batch are inserted and all queries of a block searched side by side in numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, written
from .graph import components

SHARD = 8_192
DEGREE = 16
BUILD_BEAM = 48
BEAM = 32
BATCH = 256
AUDIT = 128
WHOLE = 200 * 200
RECALL = 0.99
SLACK = 1e-3


@dataclass
class Graph:
    vectors: np.ndarray  # unit length, float32
    layers: list[np.ndarray] = field(default_factory=list)  # per layer: neighbours of every vertex, -1: none
    entry: int = 0

    def search(self, queries: np.ndarray, beam: int, starts: np.ndarray | None = None, mark=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of a beam per query, best first; ``starts`` are further places to start from.

        ``mark`` is called with (query numbers, vertices, similarities) of all vertices met on the lowest layer.
        """
        n = len(queries)
        at = np.full((n, 1), self.entry)
        for layer in self.layers[:0:-1]:
            at, _ = _beam(self.vectors, layer, queries, at, 1)
            at = at[:, :1]
        if starts is not None:
            at = np.concatenate([at, starts], axis=1)
        return _beam(self.vectors, self.layers[0], queries, at, beam, mark)


def _beam(vectors, layer, queries, starts, size, mark=None):
    """Best-first search on one layer for all queries at once."""
    n = len(queries)
    seen = np.zeros((n, len(vectors)), bool)
    ids = np.full((n, size), -1, np.int64)
    sims = np.full((n, size), -np.inf, np.float32)
    done = np.ones((n, size), bool)
    step = max(2, size // 8)

    def add(q, v):
        key = np.unique(q * len(vectors) + v)
        q, v = key // len(vectors), key % len(vectors)
        new = ~seen[q, v]
        q, v = q[new], v[new]
        if not len(q):
            return
        seen[q, v] = True
        s = np.einsum("ij,ij->i", queries[q], vectors[v])
        if mark is not None:
            mark(q, v, s)
        rows, first, count = np.unique(q, return_index=True, return_counts=True)
        slot = np.arange(len(q)) - np.repeat(first, count)
        width = int(count.max())
        more_ids = np.full((len(rows), width), -1, np.int64)
        more_sims = np.full((len(rows), width), -np.inf, np.float32)
        at = np.repeat(np.arange(len(rows)), count)
        more_ids[at, slot], more_sims[at, slot] = v, s
        all_ids = np.concatenate([ids[rows], more_ids], axis=1)
        all_sims = np.concatenate([sims[rows], more_sims], axis=1)
        all_done = np.concatenate([done[rows], more_ids < 0], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :size]
        ids[rows] = np.take_along_axis(all_ids, best, 1)
        sims[rows] = np.take_along_axis(all_sims, best, 1)
        done[rows] = np.take_along_axis(all_done, best, 1)

    q = np.repeat(np.arange(n), starts.shape[1])
    v = starts.ravel()
    add(q[v >= 0], v[v >= 0])
    while True:
        todo = ~done
        todo &= np.cumsum(todo, axis=1) <= step
        q, at = np.nonzero(todo)
        if not len(q):
            return ids, sims
        done[q, at] = True
        near = layer[ids[q, at]]
        q = np.repeat(q, near.shape[1])
        near = near.ravel()
        inside = near >= 0
        add(q[inside], near[inside])


def _spread(vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` neighbours per row of candidates (best first, -1: none).

    A candidate closer to a chosen one than to the vertex itself is put off, so that links
    lead in all directions; places left over go to those put off.
    """
    n, width = ids.shape
    c = vectors[np.maximum(ids, 0)]
    between = np.matmul(c, c.transpose(0, 2, 1))
    chosen = np.zeros((n, width), bool)
    count = np.zeros(n, np.int64)
    valid = ids >= 0
    for i in range(width):
        nearest = np.where(chosen, between[:, i, :], -np.inf).max(1)
        take = valid[:, i] & (count < degree) & (nearest < sims[:, i])
        chosen[:, i] = take
        count += take
    order = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(np.where(valid, ids, -1), order, 1)
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7) -> Graph:
    """A graph over unit vectors; vertices are inserted in batches, in a seeded random order."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    level = np.minimum((-np.log(rng.random(n)) / np.log(degree)).astype(np.int64), 4)
    if n:
        level[order[0]] = level.max()
    g = Graph(vectors, [np.full((n, degree * (2 if i == 0 else 1)), -1, np.int64) for i in range(int(level.max(initial=0)) + 1)])
    if not n:
        return g
    g.entry = int(order[0])
    at = 1
    while at < n:
        new = order[at : at + min(BATCH, max(8, at))]
        at += len(new)
        inner = vectors[new] @ vectors[new].T
        np.fill_diagonal(inner, -np.inf)
        starts = np.full((len(new), 1), g.entry)
        for i in range(len(g.layers) - 1, -1, -1):
            width = beam if i <= level[new].max() else 1
            ids, sims = _beam(vectors, g.layers[i], vectors[new], starts, width)
            starts = ids[:, :1]
            here = level[new] >= i
            if not here.any():
                continue
            peers = np.where(here, inner, -np.inf)  # vertices of the batch that are on this layer
            k = min(8, len(new))
            top = np.argsort(-peers, axis=1)[:, :k]
            peer_sims = np.take_along_axis(peers, top, 1)
            both = np.concatenate([ids, np.where(np.isfinite(peer_sims), new[top], -1)], axis=1)
            both_sims = np.concatenate([sims, peer_sims], axis=1)
            by = np.argsort(-both_sims, axis=1, kind="stable")
            both, both_sims = np.take_along_axis(both, by, 1)[here], np.take_along_axis(both_sims, by, 1)[here]
            _connect(g, i, new[here], both, both_sims, degree)
    return g


def _connect(g: Graph, i: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> None:
    layer = g.layers[i]
    most = layer.shape[1]
    picked = _spread(g.vectors, new, ids, sims, degree)
    layer[new, :degree] = picked
    source = np.repeat(new, degree)
    target = picked.ravel()
    source, target = source[target >= 0], target[target >= 0]
    if not len(target):
        return
    sim = np.einsum("ij,ij->i", g.vectors[source], g.vectors[target])
    by = np.lexsort((-sim, target))
    source, target, sim = source[by], target[by], sim[by]
    to, first, count = np.unique(target, return_index=True, return_counts=True)
    slot = np.arange(len(target)) - np.repeat(first, count)
    room = slot < 2 * degree
    fresh = np.full((len(to), int(min(count.max(), 2 * degree))), -1, np.int64)
    fresh[np.repeat(np.arange(len(to)), count)[room], slot[room]] = source[room]
    both = np.concatenate([layer[to], fresh], axis=1)
    for part in range(0, len(to), 512):
        rows = slice(part, part + 512)
        some = both[rows]
        twice = np.sort(some, axis=1)
        if (twice[:, 1:] == twice[:, :-1])[twice[:, 1:] >= 0].any():
            by = np.argsort(some, axis=1, kind="stable")
            ordered = np.take_along_axis(some, by, 1)
            ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
            some = ordered
        s = np.einsum("ij,ikj->ik", g.vectors[to[rows]], g.vectors[np.maximum(some, 0)])
        s[some < 0] = -np.inf
        by = np.argsort(-s, axis=1, kind="stable")
        some, s = np.take_along_axis(some, by, 1), np.take_along_axis(s, by, 1)
        full = (some >= 0).sum(1) > most
        kept = some[:, :most].copy()
        if full.any():
            kept[full] = _spread(g.vectors, to[rows][full], some[full], s[full], most)
        layer[to[rows], : kept.shape[1]] = kept


def linked(g: Graph, exact: np.ndarray, queries: np.ndarray, least: float, own: bool, beam: int = BEAM, seed: int = 3, back: Graph | None = None) -> np.ndarray:
    """Boolean table query x vertex of the links found; ``own``: query i is vertex i.

    ``exact`` and ``queries`` are unit vectors in double precision. ``back`` is the graph of the
    queries, searched with ``exact`` as well.
    """
    n, m = len(queries), len(exact)
    if n * m <= WHOLE:
        return _compared(exact, queries, least, own)
    rng = np.random.default_rng(seed)
    audit = rng.permutation(n)[:AUDIT]
    checked = queries[audit] @ exact.T >= least
    if own:
        checked[np.arange(len(audit)), audit] = False
    probed = [(graph, *_probes(vertices, least, rng)) for graph, vertices in ((g, exact), (back, queries)) if graph is not None]
    while True:
        if all(_recalled(_near(graph, probes.astype(np.float32), least, False, beam), true) for graph, probes, true in probed):
            near = _near(g, queries.astype(np.float32), least, own, beam)
            if back is not None:
                near |= _near(back, exact.astype(np.float32), least, False, beam).T
            found = np.zeros((n, m), bool)
            q, v = np.nonzero(near)
            for at in range(0, len(q), 100_000):
                a, b = q[at : at + 100_000], v[at : at + 100_000]
                found[a, b] = np.einsum("ij,ij->i", queries[a], exact[b]) >= least
            if own:
                found |= found.T
                np.fill_diagonal(found, False)
            busy = np.flatnonzero(found.any(1))
            sample = busy[rng.permutation(len(busy))[: AUDIT // 2]]
            truth = queries[sample] @ exact.T >= least
            if own:
                truth[np.arange(len(sample)), sample] = False
            # What found something says little of what found nothing: each of the samples must pass.
            if _recalled(found[audit], checked) and _recalled(found[sample], truth):
                return found
        if beam >= max(n, m):  # the graph leaves vertices out of reach
            return _compared(exact, queries, least, own)
        beam *= 2


def _recalled(found: np.ndarray, true: np.ndarray) -> bool:
    return bool((found & true).sum() >= RECALL * true.sum())


def _probes(vertices: np.ndarray, least: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors whose cosine to one of the vertices is just ``least``, and all their true links."""
    some = vertices[rng.permutation(len(vertices))[:AUDIT]]
    away = rng.normal(size=some.shape)
    away -= (away * some).sum(1, keepdims=True) * some
    length = np.linalg.norm(away, axis=1, keepdims=True)
    cosine = np.where(length > 1e-9, min(1.0, least + 1e-6), 1.0)  # one dimension: no other direction
    probes = cosine * some + np.sqrt(1 - cosine**2) * away / np.maximum(length, 1e-9)
    return probes, probes @ vertices.T >= least


def _near(g: Graph, short: np.ndarray, least: float, own: bool, beam: int) -> np.ndarray:
    """Boolean table query x vertex of what one search of the graph meets within reach of ``least``."""
    n, m = len(short), len(g.vectors)
    near = np.zeros((n, m), bool)
    todo, width = np.arange(n), min(beam, m)
    while len(todo):
        again = []
        per = max(8, BATCH * BEAM // width)
        for at in range(0, len(todo), per):
            some = todo[at : at + per]

            def mark(q, v, s, some=some):
                hit = s >= least - SLACK
                near[some[q[hit]], v[hit]] = True

            starts = some[:, None] if own else None
            _, sims = g.search(short[some], width, starts, mark)
            again.append(some[sims[:, -1] >= least - SLACK])
        todo = np.concatenate(again) if width < m else np.zeros(0, np.int64)
        width = min(2 * width, m)
    return near


def _compared(exact: np.ndarray, queries: np.ndarray, least: float, own: bool) -> np.ndarray:
    """The links of a block, all pairs compared."""
    found = np.zeros((len(queries), len(exact)), bool)
    for at in range(0, len(queries), 1024):
        found[at : at + 1024] = queries[at : at + 1024] @ exact.T >= least
    if own:
        np.fill_diagonal(found, False)
    return found


def _unit(rows) -> np.ndarray:
    v = np.array([r for r in rows], np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of 0 .. n-1, for links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.93,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    shard: int = SHARD,
) -> DataFrame:
    """One row per input row: ``key``, ``n_links``, ``component_id`` and ``kept``.

    Only vectors of equal labels, not null, and equal length are compared. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; so do rows with a null key or label.
    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the smallest
    key reachable. Rows that repeat a key count as rows of their own. An empty table gives no rows.
    """
    v = F.col("v")
    base = vectors.select(column(key).alias("key"), column(vector).cast("array<double>").alias("v"), column(label).cast("string").alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("key").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    digest = F.md5(F.concat_ws(",", F.col("label"), v.cast("array<string>")).cast("binary"))
    rows = written(base.withColumn("id", F.when(F.coalesce(usable, F.lit(False)), digest)), "vectors")
    classes = (
        rows.filter("id is not null")
        .groupBy("id")
        .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
        .withColumn("part", F.concat_ws("/", F.size("v").cast("string"), "label"))
    )
    classes = written(classes, "classes")
    sizes = classes.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    dealt = classes.join(sizes, "part").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))

    def built(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        exact = _unit(pdf["v"])
        g = build(exact.astype(np.float32))
        body = pickle.dumps((list(pdf["id"]), exact, pdf["copies"].to_numpy(), [x.astype(np.int32) for x in g.layers], g.entry))
        return pd.DataFrame({"part": [keys[0]], "shard": [keys[1]], "body": [body]})

    shards = dealt.select("part", "shard", "id", "copies", "v").groupBy("part", "shard").applyInPandas(built, "part string, shard long, body binary")
    shards = written(shards, "graphs")
    # Pairs of shards are made of their numbers; the graphs are joined to them shard by shard.
    one = shards.select("part", F.col("shard").alias("i"), F.col("body").alias("graph"))
    two = shards.select("part", F.col("shard").alias("j"), F.col("body").alias("other"))
    pairs = one.select("part", "i").join(two.select("part", "j"), "part").filter("i <= j")
    different = pairs.filter("i < j").join(two, ["part", "j"]).unionByName(pairs.filter("i = j").withColumn("other", F.lit(None).cast("binary")))
    blocks = different.join(one, ["part", "i"]).select("part", "i", "j", F.expr("i = j").alias("own"), "graph", "other")
    blocks = blocks.repartition("part", "i", "j")
    small_batches(vectors.sparkSession, 1)  # one row is two shards

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, graph, other in pdf[["own", "graph", "other"]].itertuples(index=False):
                ids, exact, copies, layers, entry = pickle.loads(graph)
                g = Graph(exact.astype(np.float32), [x.astype(np.int64) for x in layers], entry)
                if own:
                    found = linked(g, exact, exact, least, own=True)
                    a, b = np.nonzero(found)
                    links = found @ copies + copies - 1
                    yield pd.DataFrame({"id": ids, "links": links, "root": np.array(ids)[_roots(len(ids), a, b)]})
                else:
                    more, queries, more_copies, layers, entry = pickle.loads(other)
                    back = Graph(queries.astype(np.float32), [x.astype(np.int64) for x in layers], entry)
                    found = linked(g, exact, queries, least, own=False, back=back)
                    q, v = np.nonzero(found)
                    names = np.array(ids + more)
                    links = np.concatenate([more_copies @ found, found @ copies])
                    yield pd.DataFrame({"id": names, "links": links, "root": names[_roots(len(names), v, q + len(ids))]})

    found = written(blocks.mapInPandas(searched, "id string, links long, root string"), "links-by-shard")
    small_batches(vectors.sparkSession)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.select("id", "first").join(counts, "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    grouped = named.join(lowest, "component").select("id", "links", "lowest")
    out = rows.select("key", "id").join(grouped, "id", "left")
    component = F.coalesce("lowest", "key")
    return out.select(
        F.col("key").alias(key), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept")
    )
