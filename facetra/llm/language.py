"""Language identification by Bayesian evidence fusion.

Four kinds of evidence speak about each row: the likelihood of its text under byte-trigram
models, the language its markup declares, the suffix of its address, and its host. Text
and markup give a first posterior per row. Grouped sums of those posteriors give
counts per host and per suffix; a host's prior is smoothed towards that of its suffix, which
is smoothed towards the prior of all rows. A row never counts for its own prior.

A further hypothesis, ``und``, explains bytes at random; rows it wins, rows without a
letter and rows below the needed confidence are not identified.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, written

BUCKETS = 1 << 15
CHUNK = 1 << 18
UNDETERMINED = "und"
MAX_LANGUAGES = 200

SKIPPED = (b"script", b"style")
TAG = re.compile(rb"<!--|<(/?)([a-z][a-z0-9]*)\b[^<>]*>|<[^<>]*>", re.I)
DECLARED = re.compile(rb"<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", re.I)
LETTER = re.compile(r"[^\W\d_]")


def visible_text(page: bytes) -> bytes:
    """The text of a page without tags, comments, scripts and style sheets, in linear time."""
    out, at = [], 0
    while found := TAG.search(page, at):
        out.append(page[at : found.start()])
        at = found.end()
        name = (found.group(2) or b"").lower()
        if found.group(0) == b"<!--":
            end = page.find(b"-->", at)
            at = len(page) if end < 0 else end + 3
        elif name in SKIPPED and not found.group(1):
            end = re.compile(rb"</" + name, re.I).search(page, at)
            at = end.start() if end else len(page)
    out.append(page[at:])
    joined = b" ".join(out)
    return html.unescape(joined.decode("utf-8", "replace")).encode() if b"&" in joined else joined


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of the lower-cased text, with a space at either end."""
    data = b" " + data.lower() + b" "
    for at in range(0, max(1, len(data) - 2), CHUNK):
        b = np.frombuffer(data[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        if len(b) >= 3:
            yield (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # log probability by bucket and language; the last column is that of ``und``

    def loglik(self, data: bytes) -> tuple[np.ndarray, int]:
        total, n = np.zeros(self.table.shape[1]), 0
        for codes in grams(data):
            n += len(codes)
            if len(codes) < 4096:
                total += self.table[codes].sum(0, dtype=np.float64)
            else:
                total += np.bincount(codes, minlength=BUCKETS) @ self.table
        return total, n


def fit_text_model(labelled: DataFrame, text: str = "text", label: str = "lang", smoothing: float = 0.5) -> TextModel:
    """Trigram counts of all labelled rows, by language.

    Each task adds up its own rows; one row per (language, bucket) and task is shuffled.
    Null texts count as empty, null labels are left out. Without labelled rows the model knows
    no language. More than ``MAX_LANGUAGES`` labels are refused, which bounds the table.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.lower(column(label).cast("string")).alias("label"), F.coalesce(column(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, data in zip(batch.column("label").to_pylist(), batch.column("text")):
                if label not in sums:
                    if len(sums) >= MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    sums[label] = np.zeros(BUCKETS, np.int64)
                for codes in grams(data.as_py()):
                    sums[label] += np.bincount(codes, minlength=BUCKETS)
        for label, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], names=["label", "bucket", "n"])

    totals = rows.filter(F.col("label").isNotNull()).mapInArrow(counted, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    found = totals.limit(MAX_LANGUAGES * BUCKETS).toPandas()
    languages = sorted(found["label"].unique())
    counts = np.zeros((BUCKETS, len(languages) + 1))
    for i, language in enumerate(languages):
        own = found[found["label"] == language]
        counts[own["bucket"], i] = own["n"]
    table = np.log((counts + smoothing) / (counts.sum(0) + smoothing * BUCKETS))
    return TextModel(languages, table.astype(np.float32))


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without user, port and a leading ``www.``; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(F.length(host) > 0, F.regexp_replace(host, r"^www\.", ""))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+)$", 1)


def identify(
    rows: DataFrame,
    model: TextModel,
    key: str,
    text: Column,
    host: Column | None = None,
    suffix: Column | None = None,
    declared: Column | None = None,
    markup: bool = False,
    trust: float = 0.9,
    weight: float = 0.25,
    most: float = 60.0,
    smoothing: float = 4.0,
    confidence: float = 0.5,
    keep: list[str] | None = None,
) -> DataFrame:
    """The language of every row.

    ``markup``: ``text`` is HTML, of which the visible text counts and the declaration is read.
    ``declared``: a declaration from a column instead. ``trust`` is the probability that a
    declaration is right. ``weight`` tempers the trigrams, which are not independent, and
    ``most`` bounds the log odds that the text alone can give. ``smoothing`` is the number of rows
    that a coarser prior counts for.

    Returns ``key``, ``language`` (``und`` if not identified), ``confidence`` (posterior of the
    language; 0 without a letter in the text), ``declared``, ``host`` and the columns ``keep``.
    Null texts are empty, a null host gets the prior of its suffix, a null suffix that of all
    rows. Repeated rows count as often as they occur. An empty table gives no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    languages = model.languages
    n = len(languages)
    shared = spark.sparkContext.broadcast(model)
    null = F.lit(None).cast("string")
    base = rows.select(
        column(key).alias("key"),
        F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("text"),
        (null if declared is None else declared.cast("string")).alias("declared"),
        (null if host is None else host.cast("string")).alias("host"),
        (null if suffix is None else suffix.cast("string")).alias("suffix"),
        *[column(c).alias(f"keep_{i}") for i, c in enumerate(keep or [])],
    )
    carried = [f.name for f in base.schema if f.name not in ("text", "declared")]
    kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in carried)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            evidence, said, letters = [], [], []
            for data, claim in zip(batch.column("text"), batch.column("declared").to_pylist()):
                data = data.as_py()
                if markup:
                    found = DECLARED.search(data)
                    claim = claim or (found.group(1).decode() if found else None)
                    data = visible_text(data)
                claim = re.split(r"[-_]", claim.strip().lower())[0] if claim else None
                total, _ = model.loglik(data)
                total = np.maximum((total - total.max(initial=-np.inf)) * weight, -most)
                if claim in place and n > 1:
                    extra = np.full(n + 1, np.log((1 - trust) / (n - 1)))
                    extra[place[claim]] = np.log(trust)
                    extra[n] = np.log(1 / n)
                    total = total + extra
                evidence.append(total.tolist())
                said.append(claim)
                letters.append(bool(LETTER.search(data.decode("utf-8", "replace"))))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(said, pa.string()), pa.array(letters, pa.bool_()), pa.array(evidence, pa.list_(pa.float64()))],
                names=[*carried, "declared", "letters", "evidence"],
            )

    scored = written(base.mapInArrow(weighed, f"{kinds}, declared string, letters boolean, evidence array<double>"), "language-evidence")
    if not n:
        out = scored.withColumns({"language": F.lit(UNDETERMINED), "best": F.lit(0.0)})
    else:
        out = _fused(scored, languages, smoothing)
    sure = F.col("letters") & (F.col("best") >= confidence)
    return out.select(
        F.col("key").alias(key),
        F.when(sure, F.col("language")).otherwise(UNDETERMINED).alias("language"),
        F.when(F.col("letters"), F.col("best")).otherwise(0.0).alias("confidence"),
        "declared",
        "host",
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep or [])],
    )


def _posterior(evidence: Column) -> Column:
    """exp, normalised, of an array of log weights."""
    powers = F.transform(evidence, lambda x: F.exp(x - F.array_max(evidence)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def _fused(scored: DataFrame, languages: list[str], smoothing: float) -> DataFrame:
    """Adds ``language`` and ``best`` from the evidence and the priors of host and suffix."""
    n = len(languages) + 1
    votes = scored.withColumn("vote", F.when(F.col("letters"), _posterior(F.col("evidence"))).otherwise(F.array(*[F.lit(0.0)] * n)))
    sums = F.array(*[F.coalesce(F.sum(F.col("vote")[i]), F.lit(0.0)) for i in range(n)])
    by_host = votes.filter("host is not null").groupBy("host").agg(sums.alias("host_sum"))
    by_suffix = votes.filter("suffix is not null").groupBy("suffix").agg(sums.alias("suffix_sum"))
    everywhere = votes.agg(sums.alias("s")).first().s
    nothing = F.array(*[F.lit(0.0)] * n)

    def smoothed(counts: Column, coarser: Column) -> Column:
        own = F.zip_with(counts, F.col("vote"), lambda c, v: F.greatest(c - v, F.lit(0.0)))
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, coarser, lambda c, p: (c + smoothing * p) / (size + smoothing))

    joined = votes.join(by_host, "host", "left").join(by_suffix, "suffix", "left")
    for level, counts, coarser in (
        ("prior_all", F.array(*[F.lit(float(x)) for x in everywhere]), F.array(*[F.lit(1.0 / n)] * n)),
        ("prior_suffix", F.coalesce("suffix_sum", F.col("vote"), nothing), F.col("prior_all")),
        ("prior_host", F.coalesce("host_sum", F.col("vote"), nothing), F.col("prior_suffix")),
    ):
        joined = joined.withColumn(level, smoothed(counts, coarser))
    fused = joined.withColumn("log", F.zip_with("evidence", "prior_host", lambda e, p: e + F.log(p)))
    known = fused.withColumn("post", _posterior(F.col("log")))
    names = F.array(*[F.lit(x) for x in [*languages, UNDETERMINED]])
    at = F.array_position("post", F.array_max("post")).cast("int")
    return known.withColumn("language", F.element_at(names, at)).withColumn(
        "best", F.when(F.col("language") == UNDETERMINED, 0.0).otherwise(F.array_max("post"))
    )
