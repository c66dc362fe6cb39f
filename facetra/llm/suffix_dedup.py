"""Repeated byte strings of a minimum length, by interval expansion on Burrows-Wheeler transforms.

Every window of ``length`` bytes is filed under the smallest hash of its substrings of
``SEED`` bytes, so equal windows, wherever they are, are filed under the same anchor.
Neighbouring windows of a text mostly share their anchor; such a run is a span. Anchors that
occur once hold no repeat. Spans that are equal as a whole are repeats as a whole. Only
the other spans of repeated anchors, and one copy of each equal span, are cut out and
gathered by anchor.

Within a task, spans are joined to one text. From its suffix order comes the
Burrows-Wheeler transform. Starting from the intervals of single symbols, breadth-first
backward extension finds the boundaries between suffixes whose common prefix is 0, 1, 2, ...
bytes long, until ``length``: boundaries not found by then lie within groups of equal windows.

The spans of an anchor with many are filed a second time, under the anchor and further bytes
beside it that every window of a run holds (its core), and folded again where they are equal.
What still has many spans is dealt to several tasks. Each then reports one digest for each
distinct window, and a grouped count settles windows that are single in their task. So no
anchor is gathered in one task, and no pair is made.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, small_batches, written
from .order_minhash import BASE, _INVERSE, _powers, mix

SEED = 64
RUN = 512  # windows of a span at most
SPANS = 2_000  # of an anchor in one task
LEVELS = 3  # halvings of what a hot anchor leaves of a window
AT_ONCE = 200_000  # bytes of a text made from whole groups of spans; its arrays should fit in a cache
CHUNK = 1 << 20


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, size = v, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(v) - width + 1
    return out if size == width else np.minimum(out[:n], out[width - size : width - size + n])


def _running(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the bytes by place, and the factors that take the place out of a difference of two."""
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(b)), out=sums[1:])
    return sums, _powers(_INVERSE, len(b) + 1)


def spans_of(data: bytes, length: int, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, start, number of windows and inner repeats of every span of a text.

    Windows start at every byte that has ``length`` bytes from it on; each is in one span. The last
    array says whether a span may hold equal windows, as periodic texts do.
    """
    parts = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        b = np.frombuffer(data[at : at + CHUNK + length - 1], np.uint8)
        n = len(b)
        sums, down = _running(b)
        least = _sliding_min(mix((sums[seed:] - sums[:-seed]) * down[: n - seed + 1]), length - seed + 1)
        cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        size = np.diff(np.append(cut, len(least)))
        pieces = -(-size // RUN)
        if (pieces > 1).any():
            which = np.repeat(np.arange(len(cut)), pieces)
            step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            cut, size = cut[which] + step * RUN, np.minimum(RUN, size[which] - step * RUN)
        end = cut + size + length - 1
        content = mix((sums[end] - sums[cut]) * down[cut] + size.astype(np.uint64) * np.uint64(BASE))
        windows = (sums[length:] - sums[:-length]) * down[: len(least)]
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        inner = np.zeros(len(cut), bool)
        if len(twice):
            inner = np.add.reduceat(np.isin(windows, twice).astype(np.int64), cut) > 1
        parts.append((least[cut], content, cut + at, size, inner))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


def cores(length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the anchor in a window: first byte and end, seen from the anchor, of its core.

    A core holds the anchor and lies within the window. ``LEVELS`` times it takes half of the bytes
    left, on the side that has them; so there are 2 ** ``LEVELS`` different cores at most.
    """
    place = np.arange(length - SEED + 1)
    low, high = np.zeros(len(place), np.int64), np.full(len(place), SEED, np.int64)
    for _ in range(LEVELS):
        free = length - (high - low)
        half = (free + 1) // 2
        before = place + low >= half
        low, high = np.where(before, low - half, low), np.where(before, high, high + free - half + 1)
    return low, high


def refined(span: bytes, anchor: int, length: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of windows of a span with equal cores: a name of the core, first window, number of windows.

    Of several places of the anchor in a window the first counts. Equal windows have the anchor
    in the same place, hence equal cores.
    """
    b = np.frombuffer(span, np.uint8)
    sums, down = _running(b)
    seeds = mix((sums[SEED:] - sums[:-SEED]) * down[: len(b) - SEED + 1])
    found = np.flatnonzero(seeds == np.uint64(anchor & (1 << 64) - 1))
    windows = np.arange(len(b) - length + 1)
    at = found[np.searchsorted(found, windows)]
    start, end = low[at - windows], high[at - windows]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])]))
    out = []
    for i, size in zip(cut.tolist(), np.diff(np.append(cut, len(windows))).tolist()):
        core = span[at[i] + start[i] : at[i] + end[i]]
        name = hashlib.blake2b(int(-start[i]).to_bytes(4, "little") + core, digest_size=8).digest()
        out.append((int.from_bytes(name, "little", signed=True), i, size))
    return out


def suffix_order(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``, each up to its separator (symbol 0), ties by place.

    ``rest`` is the distance to the separator. Prefix doubling; only suffixes that still have
    equals are sorted again.
    """
    n = len(text)
    key = np.zeros(n, np.uint64)
    wide = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | np.where(j < rest, wide[j : j + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    active, known = order, 7
    while True:
        r = rank[active]
        size = np.bincount(r, minlength=n)
        active = active[size[r] > 1]
        if not (rest[active] > known).any():
            break
        longer = rest[active] > known
        then = np.zeros(len(active), np.int64)
        then[longer] = rank[active[longer] + known] + 1
        key = rank[active] * (n + 1) + then
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        at = np.arange(len(active))
        first_old = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        first_new = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
        rank[active] = old + first_new - first_old
        known *= 2
    return np.argsort(rank, kind="stable")


def equal_windows(spans: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span, offset and group of every window of ``length`` bytes; equal windows share a group.

    Breadth-first backward extension: ``open_`` marks boundaries in the suffix order whose
    common prefix is not known yet, and at step ``size`` those of ``size`` bytes are found.
    """
    lengths = np.array([len(s) for s in spans], np.int64)
    ends = np.cumsum(lengths + 1) - 1  # places of the separators
    n = int(ends[-1]) + 1 if len(spans) else 0
    if not n:
        return (np.zeros(0, np.int64),) * 3
    text = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    text[ends] = 0
    rest = np.repeat(ends, lengths + 1) - np.arange(n)
    order = suffix_order(text, rest)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1
    symbol = np.where(before >= 0, text[before], 0).astype(np.int64)  # the transform
    step = np.where(symbol > 0, place[before], -1)  # where the suffix that is one longer stands
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    first = text[order]
    cut = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (first[1:] == 0)]))
    low, high = cut, np.append(cut[1:], n)
    open_[high] = False
    for _ in range(1, length):
        if not len(low):
            break
        one = high - low == 1
        left = step[low[one]]
        left = left[left >= 0]
        right = left + 1
        low, high = low[~one], high[~one]
        if len(low):
            size = high - low
            which = np.repeat(np.arange(len(low)), size)
            at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
            key = which * 512 + symbol[at]
            inner = symbol[at] > 0
            at, key = at[inner], key[inner]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            change = np.flatnonzero(key[1:] != key[:-1])
            firsts = np.concatenate([[0], change + 1]) if len(at) else change
            lasts = np.concatenate([change, [len(at) - 1]]) if len(at) else change
            left = np.concatenate([left, step[at[firsts]]])
            right = np.concatenate([right, step[at[lasts]] + 1])
        new = open_[right]
        low, high = left[new], right[new]
        open_[high] = False
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(~open_[:n])
    at = np.flatnonzero(rest >= length)
    span = np.searchsorted(ends, at)
    return span, at - (ends[span] - lengths[span]), group[at]


def removed_ranges(docs: DataFrame, length: int = 400, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``digest``, ``data``, ``n`` (rows with this text) and ``ranges`` per distinct text.

    With ``keep`` also ``row``, these columns of one of its rows.

    ``ranges`` lists (``lo``, ``hi``): windows that start from ``lo`` to before ``hi`` occur
    elsewhere too. A text of at least ``length`` bytes that several rows hold has its whole
    length as one range. Null texts are empty. The table of distinct texts is bucketed by
    digest, so that cutting spans and applying ranges moves no text again.
    """
    if length < 2 * SEED:
        raise ValueError(f"at least {2 * SEED} bytes are needed")
    spark = docs.sparkSession
    small_batches(spark)
    data = F.coalesce(column(text).cast("string"), F.lit("")).cast("binary")
    row = [F.struct(*keep).alias("row")] if keep else []
    rows = docs.select(data.alias("data"), *row).select(F.unhex(F.md5("data")).alias("digest"), "*")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_dedup_{uuid.uuid4().hex}"
    texts = rows.groupBy("digest").agg(
        F.first("data").alias("data"), F.count(F.lit(1)).alias("n"), *[F.first("row").alias("row") for _ in row]
    )
    texts.write.option("compression", "zstd").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)
    texts = spark.table(name)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, value in zip(batch.column("digest").to_pylist(), batch.column("data")):
                anchor, content, start, size, inner = spans_of(value.as_py(), length)
                if len(anchor):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array([digest] * len(anchor), pa.binary()), pa.array(start), pa.array(size), pa.array(inner)],
                        names=["anchor", "content", "digest", "start", "size", "inner"],
                    )

    long_enough = texts.filter(F.length("data") >= length).select("digest", "data")
    spans = written(long_enough.mapInArrow(filed, "anchor long, content long, digest binary, start long, size long, inner boolean"), "spans")
    repeated = spans.groupBy("anchor").agg(F.sum(F.when(F.col("inner"), 2).otherwise(1)).alias("n")).filter("n > 1").select("anchor")
    candidates = written(spans.join(repeated, "anchor"), "repeated-spans")
    whole, wanted = _folded(candidates)
    hot = F.col("parts") > 1
    cut = lambda spans: spans.join(texts.select("digest", "data"), "digest").select(
        "anchor", "part", "parts", "digest", "start", F.expr(f"substring(data, int(start) + 1, int(size) + {length - 1})").alias("span")
    )
    low, high = cores(length)

    def filed_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, digest, start, span in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "start", "span"))):
                for name, at, size in refined(span, anchor, length, low, high):
                    piece = span[at : at + size + length - 1]
                    rows.append((name, hashlib.blake2b(piece, digest_size=16).digest(), digest, start + at, size, piece))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "content", "digest", "start", "size", "span"])

    again = cut(wanted.filter(hot)).mapInArrow(filed_again, "anchor long, content binary, digest binary, start long, size long, span binary")
    more_whole, pieces = _folded(written(again, "refined-spans"))
    whole = whole.unionByName(more_whole)
    cut = cut(wanted.filter(~hot)).unionByName(pieces.select("anchor", "part", "parts", "digest", "start", "span"))
    dealt = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    shape = "digest binary, lo long, hi long, window binary, n long"
    found = written(dealt.mapInArrow(lambda batches: _expanded(batches, length), shape), "ranges")
    local = found.filter("window is null").select("digest", "lo", "hi")
    across = found.filter("window is not null")
    several = across.groupBy("window").agg(F.sum("n").alias("total")).filter("total > 1").select("window")
    more = across.filter("digest is not null").join(several, "window").select("digest", "lo", "hi")
    ranges = whole.unionByName(local).unionByName(more).groupBy("digest").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = texts.join(ranges, "digest", "left")
    copied = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.length("data") - length + 1).cast("long").alias("hi")))
    return joined.select(
        "digest",
        "data",
        "n",
        F.when((F.col("n") > 1) & (F.length("data") >= length), copied).otherwise(F.coalesce("ranges", F.slice(copied, 1, 0))).alias("ranges"),
        *(["row"] if keep else []),
    )


def _folded(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of the spans that are equal as a whole, and the spans to be expanded with their parts.

    To be expanded are the other spans and one copy of the equal ones, where an anchor has others.
    """
    equal = spans.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("digest", "start")).alias("first"))
    marked = written(spans.join(equal, ["anchor", "content"]), "marked-spans")
    whole = marked.filter("copies > 1").select("digest", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))
    is_first = F.struct("digest", "start") == F.col("first")
    needed = marked.groupBy("anchor").agg(
        F.count_if(F.col("copies") == 1).alias("single"), F.count_if((F.col("copies") > 1) & is_first).alias("also")
    )
    needed = needed.filter("single > 0").select("anchor", F.ceil((F.col("single") + F.col("also")) / SPANS).alias("parts"))
    wanted = marked.filter((F.col("copies") == 1) | is_first).join(needed, "anchor")
    return whole, wanted.withColumn("part", F.pmod(F.xxhash64("digest", "start"), F.col("parts")))


def _expanded(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive by (anchor, part); whole groups are joined up to ``AT_ONCE`` bytes."""
    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "parts", "digest", "start", "span"))):
            if row[:2] != last and size >= AT_ONCE:
                yield _settled(held, length)
                held, size = [], 0
            last = row[:2]
            held.append(row)
            size += len(row[5])
    if held:
        yield _settled(held, length)


def _settled(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Runs of windows that occur again here; for anchors in several parts also one digest per distinct window."""
    span, offset, group = equal_windows([r[5] for r in rows], length)
    size = np.bincount(group)
    several = np.array([r[2] > 1 for r in rows])
    start = np.array([r[4] for r in rows], np.int64)
    digests, lows, highs, windows, counts = [], [], [], [], []
    again = np.flatnonzero(size[group] > 1)
    if len(again):
        new = np.concatenate([[True], (span[again][1:] != span[again][:-1]) | (offset[again][1:] != offset[again][:-1] + 1)])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(again)) - 1
        where = span[again][head]
        digests += [rows[i][3] for i in where.tolist()]
        lows += (start[where] + offset[again][head]).tolist()
        highs += (start[where] + offset[again][tail] + 1).tolist()
        windows += [None] * len(head)
        counts += [None] * len(head)
    if several.any():
        mine = np.flatnonzero(several[span])
        _, first = np.unique(group[mine], return_index=True)
        for i in mine[first].tolist():
            s, o, n = int(span[i]), int(offset[i]), int(size[group[i]])
            windows.append(hashlib.blake2b(rows[s][5][o : o + length], digest_size=16).digest())
            counts.append(n)
            digests.append(rows[s][3] if n == 1 else None)
            lows.append(rows[s][4] + o)
            highs.append(rows[s][4] + o + 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(digests, pa.binary()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64()), pa.array(windows, pa.binary()), pa.array(counts, pa.int64())],
        names=["digest", "lo", "hi", "window", "n"],
    )


def without(data: bytes, ranges: list[dict], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that no window of ``ranges`` covers, and the maximal removed runs."""
    runs: list[list[int]] = []
    for r in sorted(ranges, key=lambda r: r["lo"]):
        lo, hi = r["lo"], r["hi"] - 1 + length
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(data[at:lo])
        at = hi
    kept.append(data[at:])
    return b"".join(kept), [(lo, hi) for lo, hi in runs]


def dedup(
    docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", texts: bool = True, carry: list[str] | None = None
) -> DataFrame:
    """One row per input row, without the bytes that a repeated string of ``length`` bytes covers.

    A byte goes if it is part of ``length`` equal bytes that also start anywhere else, in the same
    text or another; texts are judged as they came. Returns ``key``, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` and, with ``texts``, ``kept`` (the other bytes joined;
    cuts may fall within a character) and ``removed`` (start and end of the runs).

    Null and empty texts keep nothing of their nothing. Rows with equal texts of at least ``length``
    bytes lose all of it, also rows that repeat a key. Null keys are no special case. An empty table
    gives no rows. Of the other columns only those named in ``carry`` are read, and returned as they are.
    """
    others = [c for c in carry or [] if c != key]
    own = [column(c).alias(f"_{i}") for i, c in enumerate([key, *others])]
    ranges = removed_ranges(docs, length, text, own if texts else None)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for data, found in zip(batch.column("data"), batch.column("ranges").to_pylist()):
                rest, runs = without(data.as_py(), found, length)
                kept.append(rest)
                removed.append(runs)
            columns = [
                batch.column("digest"),
                pa.array([len(x) for x in batch.column("data").to_pylist()], pa.int64()),
                pa.array([sum(hi - lo for lo, hi in x) for x in removed], pa.int64()),
                pa.array([len(x) for x in removed], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
            ]
            names = ["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                pair = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
                columns += [pa.array(kept, pa.binary()), pa.array([[{"lo": a, "hi": b} for a, b in x] for x in removed], pa.list_(pair))]
                names += ["kept", "removed"]
            if "row" in batch.schema.names:
                columns.append(batch.column("row"))
                names.append("row")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    shape = "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    shape += ", kept binary, removed array<struct<lo:long,hi:long>>" if texts else ""
    data = F.coalesce(column(text).cast("string"), F.lit("")).cast("binary")
    named = docs.select(F.unhex(F.md5(data)).alias("_digest"), *own)
    results = [c.split()[0] for c in shape.split(", ")][1:]
    clash = {"digest", *results} & {key, *others}
    if clash:
        raise ValueError(f"columns that the result adds cannot be carried: {sorted(clash)}")
    names = {f"_{i}": c for i, c in enumerate([key, *others])}
    if not texts:
        joined = named.join(ranges.mapInArrow(applied, shape), F.col("_digest") == F.col("digest"))
        return joined.select(*names, *results).withColumnsRenamed(names)
    # A text of one row brings its columns along and is not moved again. What several rows hold
    # is short or removed as a whole, so little is joined to them.
    kind = T.StructType([T.StructField("row", ranges.schema["row"].dataType)])
    whole = T.StructType([*T.StructType.fromDDL(shape).fields, *kind.fields])
    single = ranges.filter("n = 1").mapInArrow(applied, whole).select("row.*", *results)
    shared = ranges.filter("n > 1").drop("row").mapInArrow(applied, shape)
    joined = named.join(shared, F.col("_digest") == F.col("digest")).select(*names, *results)
    return single.unionByName(joined).withColumnsRenamed(names)
