"""Toxicity of texts that may be disguised: noisy-channel restoring, then scoring.

Disguised spans (digits or signs in place of letters, letters set apart, letters repeated)
become lattices: each place offers letters at a channel cost, a separator may vanish, a
run may shrink. The Viterbi path under a character model of the whole corpus is the
restored word. Texts are scored by the words and word beginnings they hold, as written or
as restored, with weights learned from labelled rows.

Plain words have a lattice of one path, so only disguised spans are decoded; numpy finds
them in one pass over the bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, written

ORDER = 4
SYMBOLS = 27  # 0 is everything that is no letter from a to z
STEM = 5
MAX_WORD = 60

# Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c",
    "*": "aeiou", "#": "aeiou",
}
SEPARATORS = "._-*|/~^'`,"
SIGN_COST, SKIP_COST, RUN_COST, KEEP_COST = 1.0, 0.5, 0.5, 6.0

_LETTER, _SIGN, _SEPARATOR, _SPACE, _OTHER = 1, 2, 3, 4, 0


def _classes() -> bytes:
    out = bytearray(256)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c.isalpha():
            out[b] = _LETTER
        elif c in SIGNS:
            out[b] = _SIGN
        elif c in SEPARATORS:
            out[b] = _SEPARATOR
        elif c in " \t\n\r\x0b\x0c":
            out[b] = _SPACE
    return bytes(out)


CLASSES = _classes()
WORD_BYTES = bytes(b if CLASSES[b] == _LETTER else 32 for b in range(256))
LETTERS = bytes(b for b in range(256) if CLASSES[b] == _LETTER)
STRETCHED = re.compile(rb"([a-z])\1\1")
# Signs beyond ASCII, also invisible ones, separate letters like a full stop.
FAR_SIGNS = frozenset(chr(c) for r in (range(0x80, 0x10000), range(0x1F000, 0x1FB00)) for c in r if unicodedata.category(chr(c))[0] in "PS" or unicodedata.category(chr(c)) == "Cf")
FAR_BLANKS = frozenset("\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
SPREAD = re.compile(rb"\s+(?:[._\-/~^'`,]+\s+)*")
# Plain words before an exclamation mark; ``disguised`` leaves them to ``Restorer``.
EXCLAIMED = re.compile(rb"[a-z\x80-\xff]{2,%d}!+" % MAX_WORD)
CODES = bytes(b - 96 if 97 <= b <= 122 else 0 for b in range(256))


def _codes(data: bytes) -> np.ndarray:
    c = np.frombuffer(data.translate(CODES), np.uint8).astype(np.int32)
    out = c[: len(c) - ORDER + 1].copy()
    for i in range(1, ORDER):
        out *= SYMBOLS
        out += c[i : len(c) - ORDER + 1 + i]
    return out


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each run of ``ORDER`` characters occurs in all rows; the table has a fixed size."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.lower(column(text).cast("string")).cast("binary").alias("text")).filter("text is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            for data in batch.column("text"):
                data = b"  " + data.as_py() + b" "
                if len(data) < 50_000:
                    np.add.at(total, _codes(data), 1)
                else:
                    total += np.bincount(_codes(data), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["code", "n"])

    found = rows.mapInArrow(counted, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS**ORDER, np.int64)
    out[found["code"].to_numpy(np.int64)] = found["n"].to_numpy()
    return out


class CharacterModel:
    """log P(letter | three before), backed off to two, one and none before."""

    def __init__(self, counts: np.ndarray):
        joint = counts.reshape((SYMBOLS,) * ORDER).astype(np.float64)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for used in range(ORDER):
            some = joint.sum(axis=tuple(range(ORDER - 1 - used)))
            weight = 5.0
            p = (some + weight * p) / (some.sum(-1, keepdims=True) + weight)
        self.log = np.log(p).ravel().tolist()

    def cost(self, history: int, symbol: int) -> float:
        return -self.log[history * SYMBOLS + symbol]


def _options(span: bytes) -> list[tuple[int, bool, list[tuple[int, float]]]]:
    """Per place: its byte, whether it may vanish, and the symbols it may stand for with their costs."""
    out = []
    before = -1
    stretched = {i for i in range(len(span)) if any(0 <= j and span[j : j + 3] == span[i : i + 1] * 3 for j in (i - 2, i - 1, i))}
    for i, b in enumerate(span):
        c = chr(b)
        inside = 0 < i < len(span) - 1
        if 97 <= b <= 122:
            out.append((b, b == before and i in stretched, [(b - 96, 0.0)]))
        elif c in SIGNS:
            choices = [(ord(x) - 96, SIGN_COST) for x in SIGNS[c]]
            out.append((b, inside and c in SEPARATORS or b == before, [*choices, (0, KEEP_COST)]))
        else:
            out.append((b, inside and (c in SEPARATORS or c == " "), [(0, KEEP_COST if b < 0x80 else 0.0)]))
        before = b
    return out


def decode(span: bytes, model: CharacterModel) -> bytes:
    """The most probable word behind a lower-case span without its separators, as Viterbi path.

    Places may vanish at a cost if they repeat the one before or separate letters. What is no
    letter in the path stays as it is.
    """
    wrap = SYMBOLS ** (ORDER - 2)
    paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for b, may_vanish, choices in _options(span):
        after: dict[int, tuple[float, tuple]] = {}
        for history, (cost, path) in paths.items():
            if may_vanish:
                lost = cost + (RUN_COST if 97 <= b <= 122 else SKIP_COST)
                if history not in after or lost < after[history][0]:
                    after[history] = (lost, path)
            for symbol, extra in choices:
                total = cost + extra + model.cost(history, symbol)
                follows = (history % wrap) * SYMBOLS + symbol
                if follows not in after or total < after[follows][0]:
                    after[follows] = (total, (path, symbol + 96 if symbol else b))
        paths = after
    best = min(((cost + model.cost(h, 0), path) for h, (cost, path) in paths.items()), key=lambda x: x[0])[1]
    out = bytearray()
    while best:
        best, b = best
        out.append(b)
    out.reverse()
    return bytes(out)


def disguised(data: bytes) -> set[bytes]:
    """Spans of a lower-case text that may hide a word, with and without signs at their ends."""
    if len(data) < 3:
        return set()
    kinds = np.frombuffer(data.translate(CLASSES), np.uint8)
    raw = np.frombuffer(data, np.uint8)
    letter = kinds == _LETTER
    sign = kinds == _SIGN
    inner = (sign | (kinds == _SEPARATOR))[1:-1]
    near = letter | sign
    mixed = np.flatnonzero(inner & near[:-2] & near[2:] & (letter[:-2] | letter[2:])) + 1
    runs = np.flatnonzero(letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] < 0x80)) + 1
    signs = np.flatnonzero(sign)
    token = np.cumsum(kinds == _SPACE)
    lettered = np.bincount(token[letter], minlength=token[-1] + 1) > 0
    signs = signs[lettered[token[signs]]]  # a sign anywhere in a token that has a letter
    spans: set[bytes] = set()
    done = -1
    for at in np.unique(np.concatenate([mixed, runs, signs])).tolist():
        if at < done:
            continue
        start = at
        while start > 0 and kinds[start - 1] != _SPACE:
            start -= 1
            if at - start > MAX_WORD:
                break
        done = at + 1
        while done < len(data) and kinds[done] != _SPACE:
            done += 1
        for part in _pieces(data[start:done]):
            spans.add(part)
    alone = np.zeros(len(data) + 2, bool)
    alone[1:-1] = near
    single = alone[1:-1] & ~alone[:-2] & ~alone[2:]
    linked = np.flatnonzero(single[:-4] & single[2:-2] & single[4:]) if len(data) > 4 else []
    end = -1
    for at in linked:
        at = int(at)
        if at < end:
            continue
        end = at
        while end < len(data) and single[end]:
            end += 2
        spans.add(data[at : end - 1])
    return spans


def _pieces(token: bytes) -> Iterator[bytes]:
    """A token with and without signs at its ends; long ones in overlapping pieces of at most ``MAX_WORD`` bytes."""
    outer = token.strip(b".,;:?\"')[]{}>/~^`_-")  # what may stand for no letter
    left, right = b".,;:?\"'()[]{}<>/~^`_-", b".,;:?\"')[]{}>/~^`_-!$*#|+@&%="
    forms = {outer, outer.lstrip(left), outer.rstrip(right), outer.lstrip(left).rstrip(right), token.strip(left).rstrip(b"!$*#|+@&%=")}
    for form in forms:
        for at in range(0, max(1, len(form) - MAX_WORD // 2), MAX_WORD // 2):
            part = form[at : at + MAX_WORD]
            if len(part) >= 3 and not EXCLAIMED.fullmatch(part) and (part.translate(None, LETTERS) or STRETCHED.search(part)):
                yield part


class Restorer:
    """Words of a text, as written and as restored; decoded spans are remembered up to a bound."""

    def __init__(self, model: CharacterModel, most: int = 200_000):
        self.model, self.most = model, most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # those used before the last ``most``

    def restored(self, data: bytes) -> set[bytes]:
        out = set()
        for span in disguised(data) | {m[: MAX_WORD + 1] for m in EXCLAIMED.findall(data)}:
            word = self.known.get(span)
            if word is None:
                if len(self.known) >= self.most:
                    self.known, self.older = {}, self.known
                word = self.older.get(span)
                if word is None:
                    word = decode(span, self.model)
                self.known[span] = word
            out.add(word)
        return out

    def words(self, text: str) -> set[bytes]:
        text = text.lower()
        data = text.encode("utf-8", "replace")
        words = set(data.translate(WORD_BYTES).split())
        if not text.isascii():
            used = set(text)
            marks = {ord(c): "." for c in used & FAR_SIGNS} | {ord(c): " " for c in used & FAR_BLANKS}
            if marks:
                data = text.translate(marks).encode("utf-8", "replace")
            words.update(data.translate(WORD_BYTES).split())
        data = SPREAD.sub(b" ", data)  # letters may be set apart by several blanks
        for word in self.restored(data):
            words.update(word.translate(WORD_BYTES).split())
        return words


_RESTORERS: dict[bytes, Restorer] = {}


def _restorer(characters: np.ndarray) -> Restorer:
    """One per Python worker and character table, so that later tasks know what earlier ones decoded."""
    key = hashlib.sha1(np.ascontiguousarray(characters)).digest()
    if key not in _RESTORERS:
        _RESTORERS.clear()
        _RESTORERS[key] = Restorer(CharacterModel(characters))
    return _RESTORERS[key]


def features(words: set[bytes]) -> set[bytes]:
    """Whole words, and the beginnings of longer ones marked by a ``*``."""
    return words | {w[:STEM] + b"*" for w in words if len(w) > STEM}


@dataclass
class Classifier:
    characters: np.ndarray
    weights: dict[bytes, float]
    bias: float


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = 20_000,
    most_features: int = 5_000,
    least: int = 3,
) -> Classifier:
    """Character model from all ``docs``; weights from at most ``sample`` labelled rows of them.

    ``labels`` holds ``key`` and ``label`` (0 or 1; others and null keys are left out). The sample is
    that of the smallest key hashes; being bounded, it is broadcast to find its texts. Features must
    occur in ``least`` toxic rows and be far more frequent there; the ``most_features`` most telling
    ones are kept and weighed by logistic regression. Without toxic rows every text gets the
    smoothed share of toxic rows as its score.
    """
    spark = docs.sparkSession
    characters = character_counts(docs, text)
    shared = spark.sparkContext.broadcast(characters)
    known = labels.select(column(key).alias("key"), column(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    chosen = known.orderBy(F.xxhash64("key"), "key", "label").limit(sample)
    chosen = spark.createDataFrame(chosen.toArrow(), known.schema) if known.limit(1).count() else known.limit(0)
    rows = docs.select(column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "key").select("text", "label")
    rows = written(rows.repartition(max(1, min(64, math.ceil(sample / 1000)))), "labelled-texts")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(shared.value)
        seen = (Counter(), Counter())
        totals = [0, 0]
        for batch in batches:
            for value, y in zip(batch.column("text"), batch.column("label").to_pylist()):
                seen[y].update(features(restorer.words(value.as_py())))
                totals[y] += 1
        # Features of no toxic row in this task matter only where another task has some: all go out.
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([b"", *seen[y]], pa.binary()), pa.array([y] * (len(seen[y]) + 1), pa.int32()), pa.array([totals[y], *seen[y].values()], pa.int64())],
                names=["feature", "label", "n"],
            )

    counts = (
        rows.mapInArrow(counted, "feature binary, label int, n long")
        .groupBy("feature")
        .agg(*[F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
        .persist()
    )
    head = counts.filter(F.length("feature") == 0).first()
    clean, toxic = (head.n0, head.n1) if head else (0, 0)
    prior = (toxic + 1) / (toxic + clean + 2)
    if not toxic:
        counts.unpersist()
        return Classifier(characters, {}, math.log(prior / (1 - prior)))
    odds = F.log((F.col("n1") + 0.1) / (toxic + 0.2)) - F.log((F.col("n0") + 0.1) / (clean + 0.2))
    telling = (
        counts.filter((F.col("n1") >= least) & (F.length("feature") > 0))
        .withColumn("odds", odds)
        .filter("odds > 2")
        .withColumn("gain", F.col("odds") * F.col("n1"))
        .orderBy(F.desc("gain"), "feature")
        .limit(most_features)
        .toPandas()
    )
    counts.unpersist()
    place = {bytes(f): i for i, f in enumerate(telling["feature"])}
    held = spark.sparkContext.broadcast(place)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(shared.value)
        place = held.value
        for batch in batches:
            found = [sorted(place[f] for f in features(restorer.words(x.as_py())) & place.keys()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"])

    # One short list of numbers per sampled row, summed up by equal lists.
    table = rows.mapInArrow(marked, "label int, found array<int>").groupBy("label", "found").count().toPandas()
    weights, bias = _logistic(table, len(place))
    return Classifier(characters, {f: float(weights[i]) for f, i in place.items()}, bias)


def _logistic(table, n: int, rounds: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features by gradient steps with momentum, weights at least 0."""
    found = list(table["found"])
    y = table["label"].to_numpy(np.float64)
    size = table["count"].to_numpy(np.float64)
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    col = np.concatenate([np.asarray(x, np.int64) for x in found]) if len(row) else np.zeros(0, np.int64)
    w, b = np.zeros(n), math.log((size @ y + 1) / (size.sum() - size @ y + 1))
    seen = np.bincount(col, size[row], n) + 1.0
    speed, speed_b = np.zeros(n), 0.0
    for _ in range(rounds):
        z = b + np.bincount(row, w[col], len(found))
        error = size * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(col, error[row], n) / seen + decay * w
        speed = 0.8 * speed - 0.5 * grad
        speed_b = 0.8 * speed_b - 0.5 * error.sum() / size.sum()
        w = np.maximum(w + speed, 0.0)
        b += speed_b
    return w, float(b)


def score(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``key``, ``score`` (0 to 1, higher: more likely toxic), ``predicted`` (1 from ``threshold``), ``n_hits``.

    Null and empty texts get the score of a text without telling words. Every row is scored
    on its whole text; repeated rows are scored alike, an empty table gives no rows. No column
    but ``key`` and ``text`` is read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(classifier)
    rows = docs.select(column(key).alias("key"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        restorer = _restorer(own.characters)
        weights = own.weights
        for batch in batches:
            hits = [features(restorer.words(x.as_py())) & weights.keys() for x in batch.column("text")]
            z = np.array([own.bias + math.fsum(weights[h] for h in x) for x in hits])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array([len(x) for x in hits], pa.int32())],
                names=["key", "score", "predicted", "n_hits"],
            )

    return rows.mapInArrow(scored, f"key {kind}, score double, predicted int, n_hits int").withColumnRenamed("key", key)
