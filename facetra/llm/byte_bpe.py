"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

The bytes of a pre-token are read as Latin-1 characters, so that an Aho-Corasick
automaton over the vocabulary finds the longest token that starts at each byte in
one pass. The encoder walks from longest match to longest match; where two adjacent
tokens could not both survive the merges, it falls back to the next shorter prefix,
or takes the previous token back and marks the place as closed. A place is closed
once at most, so the work is linear in the length of the pre-token, also for one of
many thousand letters. Whether two tokens can stand side by side depends on those
two alone: it is read off the last merges on both sides of their border, and remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches

MAX_PIECES = 150_000
MAX_PAIRS = 1_000_000
LONGEST_SPLIT = 500  # bytes of a token whose merges are followed


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [tokens[i] for i in range(len(tokens))]


class PieceCache(dict):
    """Encoded pre-tokens, of which about the ``MAX_PIECES`` last used stay."""

    def __init__(self, encode):
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece.encode("utf-8", "replace"))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > MAX_PIECES:
            self.older = dict(self)
            self.clear()


class ByteBPE:
    """Encoder and decoder for one vocabulary; ``tokens`` holds the bytes of each id."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        if lacking := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks {len(lacking)} of the 256 single bytes")
        self.lengths = [len(t) for t in tokens]
        self.shorter = [
            next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1) for t in tokens
        ]
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.matcher = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            if len(t) > 1:
                self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.pieces = regex.compile(pattern)
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self.column = pa.array(tokens, pa.large_binary())
        self.splits: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.cache = PieceCache(self.packed_piece)

    def merged(self, data: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first; for short strings."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, at = min(ranked)
            if rank == len(self.tokens):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of ``token`` puts together; a single byte is given twice.

        (-1, -1) if the merges never make this token, or not by rising ranks, or it is very long.
        """
        known = self.splits.get(token)
        if known is None:
            data = self.tokens[token]
            ranks, none = self.ranks, len(self.tokens)
            parts = [data[i : i + 1] for i in range(len(data))] if len(data) <= LONGEST_SPLIT else [b""] * 3
            joint = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)] if parts[0] else [none]
            while len(parts) > 2:
                rank = min(joint)
                if rank == none:
                    break
                at = joint.index(rank)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del joint[at]
                if at:
                    joint[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
                if at < len(joint):
                    joint[at] = ranks.get(parts[at] + parts[at + 1], none)
            known = (token, token) if len(parts) == 1 else (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
            if len(parts) == 2 and (max(known) > token or min(*self.split(known[0]), *self.split(known[1])) < 0):
                known = (-1, -1)
            self.splits[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` as two tokens side by side.

        From the last merge back to the first, the tokens on both sides of the border are looked
        at: a merge across it happens if it ranks before the merge that next took one of them away.
        Of equal ranks the left merge comes first.
        """
        key = left * len(self.tokens) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        tokens, ranks, split = self.tokens, self.ranks, self.split
        if split(left)[0] < 0 or split(right)[0] < 0:
            return self.merged(tokens[left] + tokens[right]) == [left, right]
        limit = len(tokens)
        while ranks.get(tokens[left] + tokens[right], limit) >= limit:
            a, b = split(left)[1], split(right)[0]  # the same token, where it is a single byte
            if a == left and b == right:
                return True
            # The later of the two last merges is undone: that of the higher rank, of equal ones the right one.
            if b == right or (a != left and left > right):
                limit, left = left, a
            else:
                limit, right = right + 1, b
        return False

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        lengths, single = self.lengths, self.single
        longest = [single[b] for b in piece]
        for end, token in self.matcher.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # for one start, longer matches end later
        closed = bytearray(size + 1)
        pairs, many = self.pairs, len(lengths)
        out: list[int] = []
        at, token = 0, longest[0] if size else -1
        while token >= 0:
            end = at + lengths[token]
            if not closed[end]:
                fits = not out or pairs.get(out[-1] * many + token)
                if fits is None:
                    fits = self.compatible(out[-1], token)
                if fits:
                    out.append(token)
                    at = end
                    token = longest[at] if at < size else -1
                    continue
            token = self.shorter[token]
            while token < 0:  # no token fits here: take the one before back and shorten it
                closed[at] = 1
                last = out.pop()
                at -= lengths[last]
                token = self.shorter[last]
        return out

    def packed_piece(self, piece: bytes) -> bytes:
        packed = self.packed
        return b"".join([packed[i] for i in self.encode_piece(piece)])

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        cache = self.cache
        cache.trim()
        return b"".join([cache[p] for p in self.pieces.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        taken = self.column.take(pa.array(np.frombuffer(ids, "<u4")))
        _, ends, data = taken.buffers()
        return data[: int(np.frombuffer(ends, np.int64)[len(taken)])].to_pybytes() if len(taken) else b""


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, the ids of the whole text, and the bytes the ids decode to.

    Returns ``key``, ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit
    integers) and ``decoded`` binary. A null or empty text gives no ids and empty bytes.
    Repeated rows and null keys are encoded like any other row; other columns of ``docs``
    are not read. ``vocabulary`` is the path of a rank file, which the driver reads and
    broadcasts; its size is that of the vocabulary, whatever the input.
    """
    return _coded(docs, vocabulary, pattern, text, key, digests=False)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As ``encode_documents``, but with SHA-256 digests instead of ids and bytes.

    Returns ``key``, ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256`` (lower-case hex).
    """
    return _coded(docs, vocabulary, pattern, text, key, digests=True)


_CODECS: dict[tuple, ByteBPE] = {}


def _codec(shared, pattern: str) -> ByteBPE:
    """One codec per Python worker and vocabulary."""
    tokens = shared.value
    key = (len(tokens), hash(tuple(tokens)), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteBPE(tokens, pattern)
    return _CODECS[key]


def _coded(docs: DataFrame, vocabulary: str, pattern: str, text: str, key: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    rows = docs.select(column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    kind = docs.select(column(key)).schema[0].dataType.simpleString()
    hexed = lambda b: hashlib.sha256(b).hexdigest()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for value in batch.column("text"):
                data = codec.encode(value.as_py())
                plain = codec.decode(data)
                counts.append(len(data) // 4)
                ids.append(hexed(data) if digests else data)
                decoded.append(hexed(plain) if digests else plain)
            out = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(ids, out), pa.array(decoded, out)],
                names=["key", "n_tokens", "ids", "decoded"],
            )

    out = "string" if digests else "binary"
    coded_rows = rows.mapInArrow(coded, f"key {kind}, n_tokens long, ids {out}, decoded {out}")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return coded_rows.toDF(key, "n_tokens", *names)
