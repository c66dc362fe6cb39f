"""Near-duplicate documents by Order MinHash.

Words give shingles of five words; the n-th occurrence of a shingle in a text is its own
item. A sketch hashes all items, takes the ``TAKEN`` smallest and keeps them in the order of
the text, so two texts share a sketch only if they share those items in that order: the
chance falls with edits and with moved passages, not only with missing items.

A sketch says little about a short text, so texts of fewer than ``SHORT`` items have an exact
index instead, which also holds every longer text that could be similar to one of them. Items
have one order, rare ones first; two similar texts share an item among the first
``n - ceil(least * n) + 1`` of each.

Texts with equal words form a class first; only one member goes on. Classes that share a
sketch or an indexed item are candidates. A bucket is searched from a hub (its smallest member): hub and
members are compared, and links make components. What is left are members of one bucket in
different components. They are dealt with their items to blocks of bounded size and compared by
a signature (smallest item in each of 256 parts of the hash range); pairs whose signatures
allow the similarity are verified within the block, the likeliest first, unless links found
there join them already. A block gives out those links, fewer than it has members. No bucket
is gathered in one task, and no pair becomes a row.

Candidates are verified by alignment: common items in text order, within the band that
the similarity allows, as the longest chain that rises in both texts. The similarity
is ``chain / (items of both - chain)``, at most the Jaccard similarity of the shingles.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, written
from .graph import components

SHINGLE = 5
TAKEN = 5
SKETCHES = 20
SIMILARITY = 0.8
SHORT = 50
COMMON = 64
MOST_COMMON = 200_000
SLOTS = 256
BLOCK = 4_096
BLOCK_ITEMS = 1 << 22  # of the members of a block, 32 MB
TILE = 256
CHUNK = 1 << 20

WORD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_RNG = np.random.default_rng(20)
MULTIPLIERS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64)


def normalised(text: str) -> bytes:
    """Lower-case words separated by one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(WORD).split())


def word_hashes(words: bytes) -> np.ndarray:
    """One hash per word of a normalised text, from running sums of its bytes."""
    if not words:
        return np.zeros(0, np.uint64)
    out = []
    start = 0
    while start < len(words):  # pieces that end between words bound the memory for very long texts
        end = len(words) if len(words) - start <= CHUNK else words.find(b" ", start + CHUNK)
        end = len(words) if end < 0 else end
        b = np.frombuffer(words[start:end], np.uint8)
        space = np.flatnonzero(b == 32)
        first = np.concatenate([[0], space + 1])
        last = np.concatenate([space, [len(b)]])
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b.astype(np.uint64) * _powers(BASE, len(b)), out=sums[1:])
        out.append(mix((sums[last] - sums[first]) * _powers(_INVERSE, len(b) + 1)[first] + (last - first).astype(np.uint64)))
        start = end + 1
    return np.concatenate(out)


def items(words: bytes) -> np.ndarray:
    """Shingles in text order, each labelled by its occurrence; no two are equal.

    A text of one to four words is a single shorter shingle; one without words has none.
    """
    w = word_hashes(words)
    if not len(w):
        return w
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * np.uint64(BASE) + w[i : i + n]
    h = mix(h + np.uint64(size))
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = s[1:] == s[:-1]
    if again.any():
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), at, 0))
        label = np.zeros(n, np.uint64)
        label[order] = (at - start).astype(np.uint64)
        h = mix(h + label * np.uint64(BASE))
    return h


def sketches(h: np.ndarray, number: int = SKETCHES, taken: int = TAKEN) -> list[int]:
    """``number`` hashes of the ``taken`` smallest items in text order."""
    out = []
    for i in range(number):
        v = (h ^ OFFSETS[i]) * MULTIPLIERS[i]
        at = np.sort(np.argpartition(v, taken - 1)[:taken]) if len(h) > taken else np.arange(len(h))
        value = i
        for x in h[at].tolist():
            value = (value * BASE + x) & MASK
        value ^= value >> 29
        out.append((value * 0xBF58476D1CE4E5B9 & MASK) - (1 << 63))
    return out


def longest_indexed(least: float) -> int:
    """Items of the longest text that can be similar to one of fewer than ``SHORT`` items."""
    return math.floor((SHORT - 1) / least + 1e-9)


def prefix(h: np.ndarray, common: np.ndarray, places: np.ndarray, least: float) -> np.ndarray:
    """The first items of a text: similar texts share one of them.

    ``common``: frequent items, sorted; ``places``: their places in the order, rarest first.
    All other items come before these, by hash.
    """
    at = np.searchsorted(common, h)
    known = np.append(common, np.uint64(0))[at] == h
    known &= at < len(common)
    place = np.where(known, np.append(places, 0)[at], -1)
    n = len(h)
    return h[np.lexsort((h, place))[: n - math.ceil(least * n - 1e-9) + 1]]


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Alignment similarity of two item sequences, or 0.0 where it is below ``least``."""
    total = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    need = least * total / (1 + least)
    band = total - 2 * need  # aligned places differ by the items without a partner at most
    near = np.abs(at_a - at_b) <= band + 1e-9
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < need - 1e-9:
        return 0.0
    chain = at_b[np.argsort(at_a)]
    length = len(chain)
    if (np.diff(chain) < 0).any():
        ends: list[int] = []
        for x in chain.tolist():
            at = bisect_left(ends, x)
            ends[at : at + 1] = [x]
        length = len(ends)
    found = length / (total - length)
    return found if found >= least - 1e-12 else 0.0


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``key``, ``digest`` of the words, ``n_items``, ``sketch`` and ``short`` per row; no digest without words.

    ``short`` holds all items of a text that goes into the index; a text below ``SHORT`` items has no sketch.
    """
    longest = longest_indexed(least)
    small_batches(docs.sparkSession)
    rows = docs.select(column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, found, short = [], [], [], []
            for value in batch.column("text"):
                words = normalised(value.as_py())
                h = items(words)
                digests.append(hashlib.sha256(words).digest()[:16] if words else None)
                sizes.append(len(h))
                found.append(sketches(h) if len(h) >= SHORT else [])
                short.append(h.view(np.int64) if len(h) <= longest else [])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, lists), pa.array(short, lists)],
                names=["key", "digest", "n_items", "sketch", "short"],
            )

    return rows.mapInArrow(made, f"key {kind}, digest binary, n_items long, sketch array<long>, short array<long>")


def _indexed(classes: DataFrame, least: float) -> DataFrame:
    """``id`` and ``band`` of the short texts: a band per item of the prefix.

    The most frequent items are counted and come last, so that what many texts share is
    seldom a band. The index is exact for any order that all texts have in common.
    """
    spark = classes.sparkSession
    short = classes.filter(F.size("short") > 0).select("id", "short")
    counts = short.select(F.explode("short").alias("item")).groupBy("item").count().filter(F.col("count") > COMMON)
    frequent = counts.orderBy(F.desc("count"), "item").limit(MOST_COMMON).toPandas()
    values = frequent["item"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(values)
    shared = spark.sparkContext.broadcast((values[by], (len(values) - np.arange(len(values)))[by]))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places = shared.value
        for batch in batches:
            found = [prefix(np.array(h, np.int64).view(np.uint64), common, places, least).view(np.int64) for h in batch.column("short").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "bands"])

    return short.mapInArrow(made, "id string, bands array<long>").select("id", F.explode("bands").alias("band"))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts are similar enough, with ``similarity``."""
    rows = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for b, text_a, text_b in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if b != hub:
                    hub, held = b, items(normalised(text_b.as_py()))
                found.append(similarity(items(normalised(text_a.as_py())), held, least))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(compared, f"a {kind}, b {kind}, similarity double").filter("similarity > 0")


def signature(h: np.ndarray) -> np.ndarray:
    """The smallest item in each of ``SLOTS`` parts of the hash range, as 31 bits; 0: none."""
    ordered = np.sort(h)
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    bounds = np.arange(SLOTS, dtype=np.uint64) << shift
    at = np.searchsorted(ordered, bounds)
    found = np.append(ordered, np.uint64(0))[at]
    inside = (at < len(ordered)) & (found >> shift == np.arange(SLOTS, dtype=np.uint64))
    return np.where(inside, (found & np.uint64(0x3FFFFFFF)).astype(np.int32) + 1, 0).astype(np.int32)


def _itemised(texts: DataFrame) -> DataFrame:
    """``id``, ``n_items`` and ``items`` (the items in text order, as bytes) of every text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [items(normalised(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())],
                names=["id", "n_items", "items"],
            )

    return texts.mapInArrow(made, "id string, n_items long, items binary")


def close_tiles(sizes: np.ndarray, slots: np.ndarray, component: np.ndarray, part: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of different components whose signatures allow a similarity of ``least``.

    Members lie in one or two ``part``s; with two, only pairs across them are compared. Pairs
    come in tiles of at most ``TILE`` rows, in each the likeliest first.
    """
    across = part.min(initial=0) != part.max(initial=0)
    rows = np.flatnonzero(part == part.min(initial=0))
    filled = slots > 0
    for at in range(0, len(rows), TILE):
        own = rows[at : at + TILE]
        same = np.zeros((len(own), len(slots)), np.uint16)
        either = np.zeros((len(own), len(slots)), np.uint16)
        for k in range(slots.shape[1]):
            mine = filled[own, k][:, None]
            same += (slots[own, k][:, None] == slots[None, :, k]) & mine
            either += mine | filled[None, :, k]
        # Slots sample the items of both without replacement: short texts are compared almost as a whole.
        union = np.maximum(sizes[own][:, None] + sizes, 1) / (1 + least)
        missed = np.clip(1 - either / union, 0.0, 1.0) + 0.02
        slack = 4 * np.sqrt(missed * least * (1 - least) / np.maximum(either, 1))
        estimate = same / np.maximum(either, 1)
        ratio = np.minimum(sizes[own][:, None], sizes) >= least * np.maximum(sizes[own][:, None], sizes)
        # Every slot that differs holds an item that only one text has: certain, and sharp where items are few.
        n = sizes[own][:, None] + sizes
        certain = either - same <= n * (1 - least) / (1 + least) + 1e-9
        short = np.maximum(sizes[own][:, None], sizes) <= longest_indexed(least)
        close = (component[own][:, None] != component) & ratio & np.where(short, certain, estimate >= least - slack)
        if across:
            close &= part[None, :] != part[own][:, None]
        else:
            close &= own[:, None] > np.arange(len(slots))
        r, c = np.nonzero(close)
        by = np.argsort(-estimate[r, c], kind="stable")
        yield own[r[by]], c[by]


def block_links(held: list[np.ndarray], component: np.ndarray, part: np.ndarray, bands: list[frozenset], band: int, least: float) -> list[tuple[int, int]]:
    """Verified links that join all members of a block which similar pairs connect: fewer than members.

    ``held``: the items of each member; ``bands``: the open buckets of each. A pair that shares
    several is verified in the smallest of them only, and no pair that links already join is.
    """
    label = np.unique(component, return_inverse=True)[1]
    sizes = np.array([len(h) for h in held], np.int64)
    slots = np.array([signature(h) for h in held], np.int32).reshape(len(held), SLOTS)
    links = []
    for left, right in close_tiles(sizes, slots, label.copy(), part, least):
        for at in range(0, len(left), TILE):
            a, b = left[at : at + TILE], right[at : at + TILE]
            apart = label[a] != label[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                if label[x] != label[y] and min(bands[x] & bands[y]) == band and similarity(held[x], held[y], least):
                    label[label == label[y]] = label[x]
                    links.append((x, y))
    return links


def _open_links(members: DataFrame, labels: DataFrame, made: DataFrame, least: float) -> DataFrame:
    """Links (``a``, ``b``) within buckets that hold several components; buckets go in blocks.

    A block holds the items of its members and verifies pairs itself, so what is given out
    grows with the members of a bucket, not with their pairs.
    """
    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")).join(made.select("id", "n_items"), "id")
    several = named.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_items").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_ITEMS)).cast("int")
    several = several.filter("low <> high").select("band", blocks.alias("blocks"))
    rows = written(named.join(several, "band"), "open")
    opened = rows.groupBy("id").agg(F.collect_set("band").alias("bands"))
    rows = rows.drop("n_items").join(opened, "id").join(made.select("id", "items"), "id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("id", "component", "items", "bands", "band", "part", other.alias("other"))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")
    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def group(held: list[tuple]) -> pa.RecordBatch:
        ids, component, values, bands, part = zip(*(r[3:] for r in held))
        arrays = [np.frombuffer(v, np.uint64) for v in values]
        links = block_links(arrays, np.array(component), np.array(part), [frozenset(x) for x in bands], held[0][0], least)
        a, b = [ids[x] for x, _ in links], [ids[y] for _, y in links]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "id", "component", "items", "bands", "part"))):
                if held and row[:3] != held[-1][:3]:
                    yield group(held)
                    held = []
                held.append(row)
        if held:
            yield group(held)

    return dealt.mapInArrow(compared, "a string, b string")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``key``, ``group_id`` (smallest key of its group) and ``kept``.

    A group holds what links of at least ``least`` connect; texts with equal words are linked.
    A row without words (null, empty, signs only) or with a null key is a group of its own.
    Rows that repeat a key are all returned; if their texts differ, each follows its own text.
    An empty table gives no rows. Columns other than ``key`` and ``text`` are not read.
    """
    all_rows = written(sketched(docs, key, text, least), "sketches")
    # Classes are named by the digest of their words; their smallest key is only shown.
    classes = (
        all_rows.filter("key is not null and digest is not null")
        .groupBy("digest")
        .agg(F.min("key").alias("first"), F.first("sketch").alias("sketch"), F.first("short").alias("short"))
    )
    classes = written(classes.select(F.hex("digest").alias("id"), "first", "sketch", "short"), "classes")
    bands = classes.select("id", F.explode(F.array_distinct("sketch")).alias("band")).unionByName(_indexed(classes, least))
    hubs = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).filter("n > 1").select("band", "hub")
    members = written(bands.join(hubs, "band"), "bands")
    labels = None
    if members.limit(1).count():
        used = classes.join(members.select("id").distinct(), "id").select(F.col("first").alias("key"), "id")
        whole = docs.select(column(key).alias("key"), column(text).cast("string").alias("text")).filter("key is not null and text is not null")
        texts = written(_right_text(whole.join(used, "key").select("id", "text")).dropDuplicates(["id"]), "texts")
        pairs = written(members.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
        links = written(_verified(pairs, texts, least), "verified")
        labels = components(links)
        made = written(_itemised(texts), "items")
        found = written(_open_links(members.select("id", "band"), labels, made, least), "verified")
        if found.limit(1).count():
            labels = _joined(labels, found)
    if labels is None:
        grouped = classes.select("id", F.col("first").alias("group_first"))
    else:
        named = classes.select("id", "first").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        lowest = named.groupBy("component").agg(F.min("first").alias("group_first"))
        grouped = named.join(lowest, "component").select("id", "group_first")
    grouped = written(grouped, "groups")
    out = all_rows.withColumn("id", F.when(F.col("key").isNotNull(), F.hex("digest"))).join(grouped, "id", "left")
    group = F.coalesce("group_first", "key")
    return out.select(F.col("key").alias(key), group.alias("group_id"), F.coalesce(F.col("key") == group, F.lit(True)).alias("kept"))


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` after further links: only links between different components are searched again."""
    ends = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct()
    every = labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component")))
    every = written(every, "labels")
    named = found.select("a", "b").join(every.withColumnsRenamed({"id": "a", "component": "c_a"}), "a")
    named = named.join(every.withColumnsRenamed({"id": "b", "component": "c_b"}), "b").filter("c_a <> c_b")
    merged = components(named.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())
    merged = merged.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return written(every.join(merged, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")


def _right_text(texts: DataFrame) -> DataFrame:
    """Of rows found by key, those whose words have the digest of the class."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [
                hashlib.sha256(normalised(t.as_py())).digest()[:16].hex().upper() == i
                for i, t in zip(batch.column("id").to_pylist(), batch.column("text"))
            ]
            yield batch.filter(pa.array(same, pa.bool_()))

    return texts.mapInArrow(checked, "id string, text string")
