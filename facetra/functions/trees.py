"""Decision trees on binned rows, as arrays: grown, pruned and scored within one task.

The method is that of MLlib's forests: candidate cuts at weighted quantiles, Poisson bootstrap, a
random subset of features a node, the cut of the largest gain (variance or Gini), and leaves of
one prediction merged. Nodes are a few bytes each, so that no process holds a forest as objects.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

# Rows of the nodes whose cuts are sought at once, so that the counters stay near the processor.
CHUNK_ROWS = 1 << 17
# A gain below this share of a node's spread is the rounding of sums.
LEAST_SHARE = 1e-9


class Growth(NamedTuple):
    """How a tree is grown."""

    depth: int
    least_rows: int  # rows a child holds at least, drawn ones counted as often as drawn
    least_weight: float  # weight a child holds at least
    least_gain: float
    subset: int  # features tried a node
    bootstrap: bool
    rate: float  # rows drawn, as a share of all
    classes: int  # 0: regression


class Tree(NamedTuple):
    """Nodes from the root down, both children of a node side by side.

    ``feature`` is -1 in leaves; ``cut`` is the last bin that goes left; ``child`` is the left child, or
    the row of ``value`` in leaves. ``value`` holds means or shares of classes.
    """

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    importance: np.ndarray

    @property
    def packed(self) -> tuple[bytes, ...]:
        return tuple(a.tobytes() for a in self)


def bin_type(bins: int) -> str:
    return "uint8" if bins <= 256 else "uint16"


def unpacked(parts: Sequence[bytes], bins: int, classes: int) -> Tree:
    kinds = ("int32", bin_type(bins), "int32", "float64", "float64")
    tree = Tree(*[np.frombuffer(p, k) for p, k in zip(parts, kinds)])
    return tree._replace(value=tree.value.reshape(-1, max(classes, 1)))


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Candidate cuts of one feature: between all neighbours, or nearest to weighted quantiles."""
    distinct, at = np.unique(values, return_inverse=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) < bins:
        return between
    counts = np.bincount(at, weights=weights)
    stride = counts.sum() / bins
    so_far = np.cumsum(counts).tolist()
    target, found = stride, []
    for i in range(1, len(so_far)):
        if abs(so_far[i - 1] - target) < abs(so_far[i] - target):
            found.append(i - 1)
            target += stride
    return between[found]


def binned(values: np.ndarray, cuts: Sequence[np.ndarray], bins: int) -> np.ndarray:
    """The bin of every value; a value equal to a cut belongs to the bin below it."""
    out = np.empty(values.shape, bin_type(bins))
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, values[:, i], side="left")
    return out


def _best(flat, at, c, count, label, part, start, tried, bins: int, weight, total, raw, how: Growth):
    """Per node: the largest score of a cut, its feature and its bin. Rows lie sorted by node."""
    k, classes = len(start) - 1, how.classes
    nid = np.repeat(np.arange(k), np.diff(start))
    row = nid * bins
    best, feature, cut = np.full(k, -np.inf), np.zeros(k, "int64"), np.zeros(k, "int64")
    place = np.empty(k * bins, "int64")
    for j in range(tried.shape[1]):
        own = tried[:, j]
        key = flat.take(at + own.take(nid)) + row
        cells = np.flatnonzero(np.bincount(key, minlength=k * bins))
        m = len(cells)
        place[cells] = np.arange(m)
        cell = place.take(key)
        node = cells // bins
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        lone = np.bincount(cell, weights=c, minlength=m)
        left = np.cumsum(lone)
        left -= (left[first] - lone[first])[node]
        if classes:
            sums = np.bincount(cell * classes + label, weights=c, minlength=m * classes).reshape(m, classes)
        else:
            sums = np.bincount(cell, weights=part, minlength=m).reshape(m, 1)
        low = np.cumsum(sums, axis=0)
        low -= (low[first] - sums[first])[node]
        right, high = weight[node] - left, total[node] - low
        allowed = np.ones(m, bool)
        allowed[np.append(first[1:], m) - 1] = False
        if how.least_rows > 1:
            rows = np.bincount(cell, weights=count, minlength=m)
            below = np.cumsum(rows)
            below -= (below[first] - rows[first])[node]
            allowed &= (below >= how.least_rows) & (raw[node] - below >= how.least_rows)
        if how.least_weight > 0:
            allowed &= (left >= how.least_weight) & (right >= how.least_weight)
        allowed &= (left > 0) & (right > 0)
        left[~allowed] = right[~allowed] = 1.0
        score = np.einsum("ij,ij->i", low, low) / left + np.einsum("ij,ij->i", high, high) / right
        score[~allowed] = -np.inf
        top = np.maximum.reduceat(score, first)
        hits = np.flatnonzero(score == top[node])[::-1]
        where = np.empty(k, "int64")
        where[node[hits]] = hits  # the first of equal ones stays
        better = top > best
        best[better], feature[better] = top[better], own[better]
        cut[better] = (cells[where] - node[where] * bins)[better]
    return best, feature, cut


def grow_tree(table: np.ndarray, label: np.ndarray, weight: np.ndarray | None, bins: int, how: Growth, rng: np.random.Generator) -> Tree:
    """One tree on rows of bins, with labels (numbers of classes, or values)."""
    n, width = table.shape
    flat, classes = table.reshape(-1), how.classes
    if how.bootstrap:
        times = rng.poisson(how.rate, n)
    else:
        times = rng.random(n) < how.rate if how.rate < 1 else np.ones(n, bool)
    rows = np.flatnonzero(times)
    count = times[rows].astype("float64")
    c = count if weight is None else count * weight[rows]
    y = label[rows]
    at = rows * width
    del times, rows
    middle = 0.0 if classes or not len(y) else float(y.mean())  # small numbers keep the sums exact
    if not classes:
        y = y - middle
    start = np.array([0, len(y)])
    levels, made = [], 0
    for depth in range(how.depth + 1):
        k = len(start) - 1
        nid = np.repeat(np.arange(k), np.diff(start))
        total_weight = np.bincount(nid, weights=c, minlength=k)
        if classes:
            total = np.bincount(nid * classes + y, weights=c, minlength=k * classes).reshape(k, classes)
            mixed, part = (total > 0).sum(axis=1) > 1, None
            spread = total_weight
        else:
            part = c * y
            total = np.bincount(nid, weights=part, minlength=k).reshape(k, 1)
            spread = np.bincount(nid, weights=part * y, minlength=k)
            mixed = np.minimum.reduceat(y, start[:-1]) < np.maximum.reduceat(y, start[:-1]) if len(y) else np.zeros(k, bool)
        raw = total_weight if weight is None else np.bincount(nid, weights=count, minlength=k)
        filled = np.where(total_weight > 0, total_weight, 1.0)
        value = total / filled[:, None]
        if not classes and len(y):
            value = value + middle
        score = np.einsum("ij,ij->i", total, total) / filled
        feature, cut, gain = np.full(k, -1, "int32"), np.zeros(k, bin_type(bins)), np.zeros(k)
        child = np.zeros(k, "int64")
        levels.append((feature, cut, child, value, gain, total))
        made += k
        open_ = np.flatnonzero(mixed & (raw >= 2 * how.least_rows) & (depth < how.depth))
        if not len(open_):
            break
        if how.subset < width:
            drawn = np.argpartition(rng.random((len(open_), width), dtype="float32"), how.subset - 1, axis=1)[:, : how.subset]
            tried = drawn  # in the order drawn: the first of equal cuts wins
        else:
            tried = np.broadcast_to(np.arange(width), (len(open_), width))
        if len(open_) < k:
            kept = np.zeros(k, bool)
            kept[open_] = True
            kept = kept[nid]
            at, c, y, nid = at[kept], c[kept], y[kept], nid[kept]
            count = c if weight is None else count[kept]
            part = None if classes else part[kept]
        sizes = np.diff(start)[open_]
        start = np.concatenate(([0], np.cumsum(sizes)))
        best, f, b = np.empty(len(open_)), np.empty(len(open_), "int64"), np.empty(len(open_), "int64")
        lo = 0
        while lo < len(open_):
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + CHUNK_ROWS, "right")) - 1)
            s, ids = slice(start[lo], start[hi]), open_[lo:hi]
            got = _best(flat, at[s], c[s], count[s], y[s], None if classes else part[s], start[lo : hi + 1] - start[lo], tried[lo:hi], bins, total_weight[ids], total[ids], raw[ids], how)
            best[lo:hi], f[lo:hi], b[lo:hi] = got
            lo = hi
        more = best - score[open_]
        parted = (more > LEAST_SHARE * (spread - score)[open_]) & (more >= how.least_gain * total_weight[open_])
        ids = open_[parted]
        if not len(ids):
            break
        feature[ids], cut[ids], gain[ids] = f[parted], b[parted], more[parted]
        child[ids] = made + 2 * np.arange(len(ids))
        # rows of parted nodes, left ones first within each
        if not parted.all():
            kept = np.repeat(parted, sizes)
            at, c, y = at[kept], c[kept], y[kept]
            count = c if weight is None else count[kept]
        sizes = sizes[parted]
        own = np.repeat(np.arange(len(ids)), sizes)
        low = flat.take(at + f[parted].take(own)) <= b[parted].take(own)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        before = np.concatenate(([0], np.cumsum(low)))
        lefts = before[begin[1:]] - before[begin[:-1]]
        rank = before[:-1] - before[begin[:-1]][own]
        to = np.where(low, begin[:-1][own] + rank, lefts[own] + np.arange(len(own)) - rank)
        moved = np.empty(len(to), "int64")
        moved[to] = np.arange(len(to))
        at, c, y = at[moved], c[moved], y[moved]
        count = c if weight is None else count[moved]
        start = np.concatenate(([0], np.cumsum(np.column_stack([lefts, sizes - lefts]).reshape(-1))))
    return _pruned(levels, width, classes)


def _pruned(levels: list, width: int, classes: int) -> Tree:
    """Leaves of one parent that predict the same become one; then only nodes in reach are kept."""
    bounds = np.concatenate(([0], np.cumsum([len(v[0]) for v in levels])))
    feature, cut, child, value, gain, total = (np.concatenate(v) for v in zip(*levels))
    said = total.argmax(axis=1) if classes else value[:, 0]
    for lo, hi in reversed([*zip(bounds[:-1], bounds[1:])]):
        inner = lo + np.flatnonzero(feature[lo:hi] >= 0)
        left = child[inner]
        same = (feature[left] < 0) & (feature[left + 1] < 0) & (said[left] == said[left + 1])
        feature[inner[same]] = -1
    alive = np.zeros(len(feature), bool)
    alive[0] = True
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        inner = lo + np.flatnonzero(alive[lo:hi] & (feature[lo:hi] >= 0))
        alive[child[inner]] = alive[child[inner] + 1] = True
    number = np.cumsum(alive) - 1
    feature, cut, child, value, gain = (v[alive] for v in (feature, cut, child, value, gain))
    leaf = feature < 0
    held = value[leaf]
    if classes:  # leaves of one class share their row
        pure = held.max(axis=1) == 1.0
        rows = np.where(pure, held.argmax(axis=1), classes + np.cumsum(~pure) - 1)
        held = np.concatenate([np.eye(classes), held[~pure]])
    else:
        rows = np.arange(len(held))
    child = number[child]
    child[leaf] = rows
    importance = np.bincount(feature[~leaf], weights=gain[~leaf], minlength=width).astype("float64")
    if importance.sum():
        importance /= importance.sum()
    return Tree(feature, np.where(leaf, 0, cut).astype(cut.dtype), child.astype("int32"), held, importance)


def leaves(tree: Tree, table: np.ndarray) -> np.ndarray:
    """The row of ``tree.value`` that each row of bins falls to."""
    n, width = table.shape
    flat = table.reshape(-1)
    node = np.zeros(n, "int32")
    if tree.feature[0] >= 0:
        going = np.arange(n)
        while len(going):
            here = node[going]
            here = tree.child[here] + (flat[going * width + tree.feature[here]] > tree.cut[here])
            node[going] = here
            going = going[tree.feature[here] >= 0]
    return tree.child[node]


def described(tree: Tree, cuts: Sequence[np.ndarray]) -> str:
    """The tree as text, one line a node."""
    lines, stack = [], [(0, 1, "")]
    while stack:
        i, indent, said = stack.pop()
        if said:
            lines.append(" " * (indent - 1) + said)
        f = tree.feature[i]
        if f < 0:
            lines.append(" " * indent + f"Predict: {tree.value[tree.child[i]].tolist()}")
            continue
        at = float(cuts[f][tree.cut[i]])
        stack.append((tree.child[i] + 1, indent + 1, f"Else (feature {f} > {at})"))
        stack.append((tree.child[i], indent + 1, f"If (feature {f} <= {at})"))
    return "\n".join(lines)
