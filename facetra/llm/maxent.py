"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class given the tokens before, times that of
the token within its class. Classes are the most frequent tokens, one each, and the endings
of the others. N-gram and skip features, that is every word one, two and three places before,
the last two words together and the pair of classes before, are hashed to rows of one weight
table, rare words by their bytes; a softmax over the summed rows gives the class.
Within a class a token has its smoothed relative frequency, which is what a softmax over
one weight per token comes to.

Training: every task walks over its own training texts with gradient steps on batches of
tokens, and the tables are averaged, each row weighted by how often a task used it.
All training tokens are counted and learned from. The most frequent tokens, a fixed
number, are broadcast; the counts of all others reach the texts by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, written

HEAD = 200_000
LONGEST = 64  # bytes of a broadcast token
SINGLES = 20
ENDINGS = 40
REST = 4
CLASSES = 1 + SINGLES + ENDINGS + REST  # class 0: end of text
ROWS, MOST_ROWS = 1 << 14, 1 << 16  # of the weight table, by the number of distinct tokens
FEATURES = 5
WALK = 8_000_000  # training tokens of a task, as each gives out a table
ROUNDS = 8
BLOCK = 1_024  # rows of a step at once, so that they stay in a cache
TILE = 4_096
COUNTER = 300_000
END = 0
ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(data: bytes) -> list[bytes]:
    """Words of a text; only A-Z are lower-cased, only the six ASCII blanks part words."""
    return data.lower().split()


@dataclass
class Vocabulary:
    head: dict[bytes, int]  # token -> place by frequency
    counts: np.ndarray  # of the head
    classes: np.ndarray  # of the head
    ending_class: dict[bytes, int]
    class_tokens: np.ndarray  # training tokens by class
    class_types: np.ndarray  # distinct training tokens by class
    train_tokens: int
    train_types: int

    def class_of(self, token: bytes) -> int:
        found = self.ending_class.get(token[-2:])
        return 1 + SINGLES + ENDINGS + zlib.crc32(token[-2:]) % REST if found is None else found

    @property
    def rows(self) -> int:
        """Rows of the weight table: as many as distinct tokens, within bounds that suit a worker's memory."""
        return min(MOST_ROWS, max(ROWS, 1 << int(self.train_types).bit_length()))

    def within(self) -> np.ndarray:
        """log10 of the share of a class that a token with no count has."""
        out = -np.log10(self.class_tokens + self.class_types + 1.0)
        out[: 1 + SINGLES] = -np.log10(np.maximum(self.class_tokens[: 1 + SINGLES], 0) + 1.0)
        return out


def counted_tokens(texts: DataFrame) -> DataFrame:
    """``token`` and ``n`` over all rows of ``texts`` (``data`` binary); summed within tasks first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for data in batch.column("data"):
                seen.update(tokens_of(data.as_py()))
                if len(seen) > COUNTER:
                    yield _counts(seen)
                    seen = Counter()
        yield _counts(seen)

    return texts.mapInArrow(counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])


def vocabulary(counts: DataFrame, train_texts: int) -> Vocabulary:
    """Head, classes and totals from ``counts``; what reaches the driver has a fixed size."""
    # The head is all tokens from some count on, found by counting counts: no task sorts the tokens.
    n = F.col("n")
    step = F.when(n < 1000, n).otherwise(1000 + F.floor(F.log(n / 1000.0) * 200)).cast("long")
    short = counts.filter(F.length("token") <= LONGEST).withColumn("step", step)
    steps = sorted(short.groupBy("step").count().collect(), reverse=True)  # a few thousand rows at most
    within = np.cumsum([r["count"] for r in steps]) <= HEAD
    cut = steps[int(within.sum()) - 1]["step"] if within.any() else -1
    head = sorted(short.filter(F.col("step") >= cut).select("n", "token").collect() if cut > 0 else [], key=lambda r: (-r.n, r.token))
    tokens, n = [bytes(r.token) for r in head], np.array([r.n for r in head], np.int64)
    ending = F.when(F.length("token") >= 2, F.substring("token", -2, 2)).otherwise(F.col("token"))
    by_ending = counts.groupBy(ending.alias("ending")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))
    endings = {bytes(r.ending): (r.n, r.types) for r in by_ending.collect()}  # at most 65,792 endings
    for token, c in zip(tokens[:SINGLES], n[:SINGLES].tolist()):
        a, b = endings[token[-2:]]
        endings[token[-2:]] = (a - c, b - 1)
    common = sorted(endings, key=lambda e: (-endings[e][0], e))[:ENDINGS]
    ending_class = {e: 1 + SINGLES + i for i, e in enumerate(common)}
    out = Vocabulary(
        {t: i for i, t in enumerate(tokens)}, n, np.zeros(len(tokens), np.int32), ending_class,
        np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64),
        sum(a for a, _ in endings.values()) + int(n[:SINGLES].sum()) + train_texts,
        sum(b for _, b in endings.values()) + len(tokens[:SINGLES]) + (train_texts > 0),
    )
    out.classes = np.array([1 + i if i < SINGLES else out.class_of(t) for i, t in enumerate(tokens)], np.int32)
    for e, (a, b) in endings.items():
        out.class_tokens[out.class_of(e)] += a
        out.class_types[out.class_of(e)] += b
    out.class_tokens[0], out.class_types[0] = train_texts, train_texts > 0
    singles = len(tokens[:SINGLES])
    out.class_tokens[1 : 1 + singles] = n[:SINGLES]
    out.class_types[1 : 1 + singles] = 1
    return out


@dataclass
class Tokens:
    """The tokens of some texts as numbers, each text followed by its end."""

    places: np.ndarray  # place in the head, -1: other token, -2: end
    classes: np.ndarray
    rows: np.ndarray  # feature rows, tokens x features
    starts: np.ndarray  # of each text
    others: pa.ListArray  # tokens outside the head, by text


def numbered(texts: list[bytes], v: Vocabulary) -> Tokens:
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    words, lengths = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not filled.all():  # blanks at the ends of a text
        lengths = np.bincount(np.repeat(np.arange(len(texts)), lengths)[filled], minlength=len(texts))
        words = words.filter(pa.array(filled))
    coded = words.view(pa.binary()).dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    get = v.head.get
    found = np.array([get(w, -1) for w in distinct], np.int32)
    group, name = np.zeros(len(distinct), np.int32), found.astype(np.int64) + 1
    group[found >= 0] = v.classes[found[found >= 0]]
    for i in np.flatnonzero(found < 0).tolist():
        group[i], name[i] = v.class_of(distinct[i]), (1 << 32) + zlib.crc32(distinct[i])
    n = len(code) + len(texts)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    inside = np.ones(n, bool)
    inside[ends] = False
    place, cls, named = np.full(n, -2, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    place[inside], cls[inside], named[inside] = found[code], group[code], name[code]
    rare = place[inside] == -1
    before = np.concatenate([[0], np.cumsum(rare)])[np.concatenate([[0], np.cumsum(lengths)])]
    others = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), coded.dictionary.take(pa.array(code[rare])))
    since = np.arange(n) - np.repeat(starts, lengths + 1)
    rows = np.empty((FEATURES + 1, n), np.uint16)  # contiguous by feature
    rows[0] = 0
    words_back, classes_back = [], []
    for k in (1, 2, 3):
        word, group = np.zeros(n, np.int64), np.zeros(n, np.int64)
        word[k:], group[k:] = named[:-k], cls[:-k] + 1
        word[since < k] = group[since < k] = 0
        rows[k] = _row(word, k, v.rows)
        words_back.append(word)
        classes_back.append(group)
    rows[4] = _row(classes_back[0] * (CLASSES + 1) + classes_back[1], 4, v.rows)
    rows[5] = _row(words_back[0] * 0x2545F491 + words_back[1], 5, v.rows)
    return Tokens(place, cls, rows.T, starts, others)


def _row(value: np.ndarray, kind: int, rows: int) -> np.ndarray:
    """Row of a hashed feature; row 0 is kept for the bias."""
    mixed = (value.astype(np.uint64) * np.uint64(8) + np.uint64(kind)) * ODD
    mixed ^= mixed >> np.uint64(29)
    mixed *= ODD
    mixed >>= np.uint64(40)
    return 1 + mixed % np.uint64(rows - 1)


class Scratch:
    """Room for the rows of a tile, used again and again: fresh arrays of this size cost more than the sums in them."""

    def __init__(self):
        self.sums, self.part = (np.empty((TILE, CLASSES), np.float32) for _ in range(2))
        self.grad, self.weights = (np.empty((FEATURES * TILE + 1, CLASSES), np.float32) for _ in range(2))
        self.square = np.empty((BLOCK, CLASSES), np.float32)


def _taken(table: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.take(table, rows, axis=0, out=out[: len(rows)], mode="clip")  # "raise" would copy; rows are in range


def _sums(table: np.ndarray, rows: np.ndarray, room: Scratch) -> np.ndarray:
    """Summed rows of the features, less the largest sum of each token."""
    z = _taken(table, rows[:, 1], room.sums)
    for k in range(2, rows.shape[1]):
        z += _taken(table, rows[:, k], room.part)
    z += table[0]
    z -= z.max(1, keepdims=True)
    return z


def class_logs(table: np.ndarray, t: Tokens) -> np.ndarray:
    """Natural log of the probability of each token's class."""
    out = np.empty(len(t.classes))
    room = Scratch()
    for at in range(0, len(out), TILE):
        z = _sums(table, t.rows[at : at + TILE], room)
        own = z[np.arange(len(z)), t.classes[at : at + TILE]]
        out[at : at + TILE] = own - np.log(np.exp(z, out=z).sum(1))
    return out


def first_table(v: Vocabulary) -> np.ndarray:
    """All weights zero but the bias, which has the class shares."""
    table = np.zeros((v.rows, CLASSES), np.float32)
    table[0] = np.log((v.class_tokens + 0.5) / (v.class_tokens.sum() + 0.5 * CLASSES))
    return table


def descend(table: np.ndarray, squares: np.ndarray, used: np.ndarray, t: Tokens, rate: float = 0.25) -> None:
    """One gradient step per tile of tokens, scaled by the squares gathered so far."""
    room = Scratch()
    for at in range(0, len(t.classes), TILE):
        rows, cls = t.rows[at : at + TILE], t.classes[at : at + TILE]
        z = _sums(table, rows, room)
        error = np.exp(z, out=z)
        error *= 1 / error.sum(1, keepdims=True)
        error[np.arange(len(cls)), cls] -= 1
        _step(table, squares, used, np.zeros(1, np.int64), error.sum(0, keepdims=True), [len(cls)], rate, room)
        own, grad, size = _gradients(error, rows, room)
        _step(table, squares, used, own, grad, size, rate, room)


def _gradients(error: np.ndarray, rows: np.ndarray, room: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that the features of a tile take, the errors of their tokens summed, and the number of them.

    Rows stand in falling order of their number, so that adding the next error to all that have one is
    one sum over a slice; what is left of the few with more than ``ROUNDS`` is added as segments.
    """
    flat = rows[:, 1:].T.reshape(-1)
    order = np.argsort(flat, kind="stable")  # radix sort: 16 bits
    own = flat[order]
    token = order % len(rows)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    size = np.diff(np.append(first, len(own)))
    by = np.argsort(-np.minimum(size, 1 << 14).astype(np.int16), kind="stable")
    first, size = first[by], size[by]
    more = np.searchsorted(-size, -np.arange(1, ROUNDS + 1), side="left")  # how many have over 1, 2, ... tokens
    grad = _taken(error, token[first], room.grad)
    for k, m in enumerate(more[:-1].tolist(), 1):
        grad[:m] += _taken(error, token[first[:m] + k], room.weights)
    m = int(more[-1])
    if m:
        rest = size[:m] - ROUNDS
        at = np.cumsum(rest) - rest
        places = np.arange(int(rest.sum())) - np.repeat(at - first[:m] - ROUNDS, rest)
        grad[:m] += np.add.reduceat(_taken(error, token[places], room.weights), at, axis=0)
    return own[first].astype(np.int64), grad, size


def _step(table, squares, used, own, grad, count, rate, room) -> None:
    used[own] += count
    for at in range(0, len(own), BLOCK):
        part, g = own[at : at + BLOCK], grad[at : at + BLOCK]
        square = _taken(squares, part, room.square)
        square += np.multiply(g, g, out=room.weights[: len(part)])
        squares[part] = square
        g /= np.sqrt(square, out=square)
        g *= rate
        weights = _taken(table, part, room.weights)
        weights -= g
        table[part] = weights


def train(texts: DataFrame, v: Vocabulary) -> np.ndarray:
    """The weight table after one pass of every task over its own ``texts``, averaged."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(v)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        table = first_table(v)
        squares = np.ones_like(table)
        used = np.zeros(v.rows, np.int64)
        for batch in batches:
            for some in _groups(batch.column("data")):
                descend(table, squares, used, numbered(some, v))
        at = np.flatnonzero(used)
        for lo in range(0, len(at), 2_000):
            part = at[lo : lo + 2_000]
            weights = pa.array((table[part] * used[part, None]).astype(np.float32).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * CLASSES), weights)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(used[part]), lists], names=["row", "used", "w"])

    tasks = max(1, -(-v.train_tokens // WALK))
    sums = texts.coalesce(tasks).mapInArrow(walked, "row int, used long, w array<float>").groupBy("row").agg(
        F.sum("used").alias("used"), F.array(*[F.sum(F.col("w")[i]) for i in range(CLASSES)]).alias("w")
    )
    table = first_table(v)
    found = sums.toArrow()  # at most ``MOST_ROWS`` rows
    for part in found.to_batches():
        row, used = (part.column(c).to_numpy() for c in ("row", "used"))
        table[row] = part.column("w").flatten().to_numpy().reshape(-1, CLASSES) / used[:, None]
    return table


def _groups(column) -> Iterator[list[bytes]]:
    """Texts in groups of about two megabytes, so that long ones do not add up."""
    some, size = [], 0
    for value in column:
        some.append(value.as_py())
        size += len(some[-1])
        if size > 2_000_000:
            yield some
            some, size = [], 0
    if some:
        yield some


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows by models of the rows that are not held out.

    Returns ``key``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (log10 probability under smoothed token counts) and ``score``
    (that of the model). A null text is empty and has one token, its end; a null ``held_out``
    counts as false. Repeated rows count and are scored as often as they occur. Without
    training rows all counts are zero. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        column(key).alias("key"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(column(text).cast("string"), F.lit("")).cast("binary").alias("data"),
    )
    training = rows.filter(~F.col("held_out")).select("data")
    n_texts = training.count()
    counts = written(counted_tokens(training), "token-counts")
    v = vocabulary(counts, n_texts)
    table = train(training, v)
    shared = spark.sparkContext.broadcast((v, table))
    kind = rows.schema["key"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = shared.value
        base_unit = -np.log10((v.train_tokens + 1.0 * (v.train_types + 1)))
        gain = np.log10(np.append(v.counts, [v.class_tokens[0], 0]) + 1.0)  # places -2 and -1: end, other
        within = v.within()
        for batch in batches:
            sizes, known, base, full, others = [], [], [], [], []
            for some in _groups(batch.column("data")):
                t = numbered(some, v)
                inside = gain[t.places]
                by_class = class_logs(table, t)
                size = np.diff(np.append(t.starts, len(t.classes)))
                inner = inside + within[t.classes]
                sizes += size.tolist()
                seen = (t.places != -1) & ~((t.places == -2) & (v.class_tokens[0] == 0))
                known += np.add.reduceat(seen.astype(np.int64), t.starts).tolist()
                base += (np.add.reduceat(inside, t.starts) + size * base_unit).tolist()
                full += np.add.reduceat(inner + by_class / np.log(10), t.starts).tolist()
                others.append(t.others)
            rare = pa.concat_arrays(others) if others else pa.array([], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("held_out"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64()), rare],
                names=["key", "held_out", "n_tokens", "n_known", "base_score", "score", "others"],
            )

    shape = f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, others array<binary>"
    partly = written(rows.mapInArrow(scored, shape).withColumn("row", F.monotonically_increasing_id()), "partly-scored")
    tails = (
        partly.select("row", F.explode("others").alias("token"))
        .join(counts, "token")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("also"))
    )
    more, also = F.coalesce("more", F.lit(0.0)), F.coalesce("also", F.lit(0))
    return partly.join(tails, "row", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + also).alias("n_known"),
        F.lit(v.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
