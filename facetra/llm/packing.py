"""Best-fit packing of tokenised documents into sequences, improved by swaps.

Documents become token ids, and those longer than a sequence are cut. All pieces are dealt
to groups of a few thousand. Within a group, best fit in falling order places them, and a
local search goes on from there: the emptiest bin gives pieces to fuller ones by moves and
by exchanges of one for one, two for one and one for two, each of which raises the sum of
squared fills, until the bin is empty. Bins that are not full are then dealt to new groups
as they are and searched again together, until two rounds save no bin or none can be saved.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, small_batches, written

GROUP = 4_096  # pieces searched together
WIDE = 128  # bins that two for one is tried with
MAX_ROUNDS, IDLE_ROUNDS = 12, 2  # rounds at most, and rounds in a row that save nothing
MAX_TASKS = 10_000
KNOWN = 300_000  # words remembered, twice: the last used, and those before them

# Chunks of these characters are split here; all others go through the library as they are.
# Within this range the library's normaliser only changes letter case.
PLAIN = re.compile("[!-~À-įı-ſ]+")
LETTER = "a-zß-öø-ſ"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^{LETTER}0-9]+")
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+")  # chunks that are one word
#: What WORDS stands for: the split of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Memory(dict):
    """Ids of texts; about the last ``KNOWN`` used stay."""

    def __init__(self, make):
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > KNOWN:
            self.older = dict(self)
            self.clear()


class WordEncoder:
    """Ids of whole texts, as the library gives them, by remembered chunks between blanks.

    The vocabulary's normaliser and splitter never join what white space parts, so a text has
    the ids of its chunks in turn. The ids of every chunk and word come from the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        parts = str(self.tokenizer.pre_tokenizer)
        self.own = SPLIT.replace("\\", "") in parts.replace("\\", "")
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.packed = [i.to_bytes(4, "little") for i in range(top + 1)]
        self.words = Memory(self._word)
        self.chunks = Memory(self._chunk)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(word)])

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(string.punctuation)
        if self.own and (word.isascii() and word.isalpha() or LETTERS.fullmatch(word)):  # so are most chunks: one word, and signs after it
            ids = self.words[word.lower()]
            return ids if len(word) == len(chunk) else ids + self.words[chunk[len(word) :]]
        if self.own and PLAIN.fullmatch(chunk):
            words = self.words
            return b"".join([words[w] for w in WORDS.findall(chunk.lower())])
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text ends."""
        self.words.trim()
        self.chunks.trim()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        chunks = self.chunks
        parts = [chunks[c] for c in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        at = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        ids = np.frombuffer(b"".join(parts), "<u4")
        starts = np.cumsum(sizes) - sizes
        size, start = (sizes[at], starts[at]) if len(at) else (sizes[:0], sizes[:0])
        ends = np.cumsum(size)
        flat = ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        chunks_before = pc.list_value_length(split).to_numpy(zero_copy_only=False).cumsum()
        return flat, np.concatenate([[0], ends])[chunks_before]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, text: str = "text", key: str = "doc_id", end: int = 0) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every document's pieces.

    A document is the ids of its whole text and then ``end``; every ``capacity`` of them make
    a piece, and what is left makes the last one. A null or empty text has one id, ``end``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    kind = docs.select(column(key)).schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            flat, ends = encoder.encode(batch.column("text"))
            owner, piece, length, crc, begin = [], [], [], [], 0
            for i, stop in enumerate(ends.tolist()):
                ids = np.append(flat[begin:stop], np.uint32(end)).astype("<u4")
                begin = stop
                for n, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    owner.append(i)
                    piece.append(n)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            n = pa.array(piece, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(owner, pa.int64())),
                    n,
                    pc.multiply(n.cast(pa.int64()), capacity),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["key", "piece", "start", "length", "ids_crc32"],
            )

    out = rows.mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids_crc32 long")
    return out.toDF(key, "piece", "start", "length", "ids_crc32")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each size, by best fit in falling order."""
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0  # bit r: there is a bin with r tokens to spare
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        if room > size:
            by_room[room - size].append(b)
            open_rooms |= 1 << (room - size)
    return bins


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """Bins that no packing can do without.

    For every k, pieces above ``capacity - k`` are alone, pieces above half share no bin with one
    another, and what pieces of k to half do not find beside them takes bins of its own.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    many, much = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2
    above = many[capacity] - many[half]
    beside = capacity * (many[capacity - k] - many[half]) - (much[capacity - k] - much[half])
    small = much[half] - np.where(k > 0, much[np.maximum(k - 1, 0)], 0)
    return int(above + np.maximum(0, -(-(small - beside) // capacity)).max())


def _pairs(sizes: np.ndarray, rows: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every two of ``rows`` that share a bin, equal sizes of a bin at most twice. ``rows`` is sorted by bin and size."""
    if len(rows) > 2:
        same = (bins[rows][2:] == bins[rows][:-2]) & (sizes[rows][2:] == sizes[rows][:-2])
        rows = rows[np.concatenate([[True, True], ~same])]
    left, right, lag = [], [], 1
    while lag < len(rows):
        at = np.flatnonzero(bins[rows][lag:] == bins[rows][:-lag])
        if not len(at):
            break
        left.append(rows[at])
        right.append(rows[at + lag])
        lag += 1
    empty = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def search(sizes: np.ndarray, bins: np.ndarray, capacity: int, steps: int | None = None) -> np.ndarray:
    """``bins`` after swaps: the emptiest bin gives until it is empty or nothing helps.

    Each step moves the most tokens that any fuller bin has room for: one or two pieces of
    the emptiest bin for nothing or for one piece, or one of its pieces for two. The fuller
    bin grows and the emptier one shrinks, so the sum of squared fills rises every time. The
    search ends when no bin can be saved, nothing helps, or after ``steps`` tries (256 for each
    bin above the least that can do, as many as there are pieces at most). Two for one is tried
    with the ``WIDE`` bins that have the most room.
    """
    bins = np.unique(bins, return_inverse=True)[1].astype(np.int64)
    fill = np.bincount(bins, sizes).astype(np.int64)
    stuck = np.zeros(len(fill), bool)
    n_bins, least = len(fill), least_bins(sizes, capacity)
    left_steps = min(len(sizes), 256 * (n_bins - least)) if steps is None else steps
    while n_bins > least and left_steps > 0:
        givers = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if len(givers) < 2:
            break
        giver = int(givers[np.argmin(fill[givers])])
        changed = False
        while fill[giver] and left_steps > 0:
            left_steps -= 1
            takers = (fill < capacity) & (fill >= fill[giver])
            takers[giver] = False
            own = np.flatnonzero(bins == giver)
            one, first = np.unique(sizes[own], return_index=True)
            own = own[np.argsort(sizes[own], kind="stable")]
            two_a, two_b = _pairs(sizes, own, bins)
            gives = np.concatenate([one, sizes[two_a] + sizes[two_b]])
            order = np.argsort(gives, kind="stable")
            own_first = np.flatnonzero(bins == giver)[first]
            left = np.concatenate([own_first, two_a])[order]
            right = np.concatenate([np.full(len(one), -1), two_b])[order]
            gives = gives[order]
            others, into = np.flatnonzero(takers[bins]), np.flatnonzero(takers)
            take = np.concatenate([np.zeros(len(into), np.int64), sizes[others]])
            taker = np.concatenate([into, bins[others]])
            moved, back, to = [], [], -1
            if len(take):
                best = np.searchsorted(gives, take + capacity - fill[taker], "right") - 1
                gain = np.where(best >= 0, gives[best] - take, 0)
                k = int(np.argmax(gain))
                if gain[k] > 0:
                    to = int(taker[k])
                    back = [] if k < len(into) else [int(others[k - len(into)])]
                    moved = [int(x) for x in (left[best[k]], right[best[k]]) if x >= 0]
            if not moved and len(into):
                wide = np.zeros(len(fill), bool)
                wide[into[np.argsort(fill[into], kind="stable")[:WIDE]]] = True
                others = others[wide[bins[others]]]
                a, b = _pairs(sizes, others[np.lexsort((sizes[others], bins[others]))], bins)
                if len(a):
                    sums = sizes[a] + sizes[b]
                    best = np.searchsorted(one, sums + capacity - fill[bins[a]], "right") - 1
                    gain = np.where(best >= 0, one[best] - sums, 0)
                    k = int(np.argmax(gain))
                    if gain[k] > 0:
                        to, back, moved = int(bins[a[k]]), [int(a[k]), int(b[k])], [int(own_first[best[k]])]
            if not moved:
                break
            amount = int(sizes[moved].sum() - sizes[back].sum())
            bins[moved] = to
            bins[back] = giver
            fill[to] += amount
            fill[giver] -= amount
            changed = True
        if fill[giver] == 0:
            n_bins -= 1
        if changed:
            stuck[:] = False
        stuck[giver] = True
    return bins


def _searched(capacity: int, start: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_key", kind="stable")
        sizes = rows["length"].to_numpy()
        bins = best_fit(sizes, capacity) if start else rows["_bin"].to_numpy()
        bins = np.unique(search(sizes, bins, capacity), return_inverse=True)[1]
        rows["_fill"] = np.bincount(bins, sizes).astype(np.int64)[bins]
        rows["_bin"] = (np.int64(key[0]) << 16) + bins
        rows["offset"] = rows.groupby("_bin")["length"].cumsum() - rows["length"]
        return rows

    return run


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """``parts`` (rows with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Every row is placed once; a sequence holds at most ``capacity`` tokens, gapless from 0. No
    rows give no rows; rows of equal length, also all of one length, are dealt by position.
    The number of sequences depends on how rows meet in groups, the result's wholeness does not.
    """
    if clash := {"_key", "_bin", "_fill", "_group", "sequence_id", "offset"} & {c.lower() for c in parts.columns}:
        raise ValueError(f"rename {sorted(clash)} first")
    names = parts.columns
    parts = written(parts.withColumn("_key", F.monotonically_increasing_id()), "pieces")
    alone = parts.filter(F.col("length") >= capacity)
    done = [alone.select(*names, (-1 - F.col("_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    open_rows = parts.filter(F.col("length") < capacity).select(*names, "_key", F.col("_key").alias("_bin"), F.lit(0).cast("long").alias("_fill"), F.lit(0).cast("long").alias("offset"))
    shape = open_rows.schema
    before, idle = None, 0
    for round_ in range(MAX_ROUNDS):
        n, tokens = open_rows.agg(F.count(F.lit(1)), F.sum("length")).first()
        if n == 0:
            break
        groups = math.ceil(n / GROUP)
        dealt = open_rows.withColumn("_group", F.pmod(F.xxhash64("_bin", F.lit(round_)), F.lit(groups)) + (round_ << 36))
        dealt = dealt.repartition(min(groups, MAX_TASKS), "_group")
        kept = T.StructType([*shape.fields])
        found = dealt.groupBy("_group").applyInPandas(_without_group(_searched(capacity, round_ == 0)), kept)
        found = written(found, "packed")
        done.append(found.filter(F.col("_fill") == capacity).select(*names, F.col("_bin").alias("sequence_id"), "offset"))
        open_rows = found.filter(F.col("_fill") < capacity)
        bins, left = open_rows.agg(F.sum(F.when(F.col("offset") == 0, 1).otherwise(0)), F.sum("length")).first()
        full = ((tokens or 0) - (left or 0)) // capacity
        saved = None if before is None else before - (bins or 0) - full
        before = bins or 0
        idle = idle + 1 if saved == 0 else 0
        if groups == 1 or before <= math.ceil((left or 0) / capacity) or idle == IDLE_ROUNDS:
            break
    done.append(open_rows.select(*names, F.col("_bin").alias("sequence_id"), "offset"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _without_group(run):
    def inner(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return run(key, rows.drop(columns="_group"))

    return inner


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2_048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens, each with its place in a sequence.

    Returns ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and
    ``offset``. Only documents of more than ``capacity`` ids are cut. Null and empty texts are one
    id; null keys and repeated rows are packed like any other row; other columns are not read;
    an empty table gives no rows.
    """
    return pack(pieces(docs, vocabulary, capacity, text, key), capacity)
