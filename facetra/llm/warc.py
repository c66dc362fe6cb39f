"""Content-addressed WARC archive: payload bytes once, record headers apart, joins to restore.

``write_archive`` makes two tables. ``payloads`` holds each distinct payload once under
its SHA-256; ``headers`` holds the exact header block of every record and the digest of
its payload. ``restore`` joins the two into the original records; the records of one payload
are dealt to parts of about ``COPIES_AT_ONCE`` by a hash of key and address.

The payload to store is picked by ids: digests are grouped (only digests, lengths and
ids are shuffled), then the chosen rows are found by a join on the record's own id, which
no hot payload can make uneven. Digests are verified: payloads that share a SHA-256 must
also agree in length, SHA-1 and a 64-bit hash, and what is read back must still have its digest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import shared_folder
from .common import column

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"
COPIES_AT_ONCE = 20_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32)


@dataclass
class Archive:
    """Paths of the two tables."""

    headers: str
    payloads: str


def _record_id(key: Column) -> Column:
    """A record id that follows from the key: the first 128 bits of its SHA-1 as a UUID."""
    hexed = F.sha1(F.concat(F.lit("record:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    parts = [F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(
    pages: DataFrame,
    folder: str | None = None,
    key: str = "page_id",
    url: str = "url",
    body: str = "html",
    smallest: int = 0,
    date: str = "2000-01-01T00:00:00Z",
) -> Archive:
    """One record per row: a response, or a revisit of the response with an equal payload.

    Of the records with equal payloads of at least ``smallest`` bytes, the one with the
    smallest ``key`` is the response. A null body is an empty payload, a null url an empty
    target. Rows with a null key get a record of their own and become the response only if
    no other row has the payload. Rows that repeat a key and a payload are all responses,
    and the payload is stored once. An empty table gives two empty tables. Further columns
    are not archived.
    """
    spark = pages.sparkSession
    base = f"{folder or shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archive = Archive(f"{base}/headers", f"{base}/payloads")
    rows = pages.select(
        column(key).alias("key"),
        F.coalesce(column(url).cast("string"), F.lit("")).alias("url"),
        F.coalesce(column(body).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    described = rows.select(
        "key",
        "url",
        F.sha2("payload", 256).alias("content"),
        base32_sha1(F.col("payload")).alias("digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.xxhash64("payload").alias("check"),
    )
    groups = described.groupBy("content").agg(
        F.min("key").alias("first"),
        F.ceil(F.count(F.lit(1)) / COPIES_AT_ONCE).alias("parts"),
        *[F.assert_true(F.min(c) == F.max(c), F.lit("different payloads share a digest")).alias(f"same_{c}") for c in ("digest", "payload_bytes", "check")],
    )
    groups = groups.filter(" and ".join(f"same_{c} is null" for c in ("digest", "payload_bytes", "check")))
    is_response = F.col("key").eqNullSafe(F.col("first")) | (F.col("payload_bytes") < smallest)
    target = F.when(~is_response, F.col("first"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("key"))),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(~is_response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(~is_response, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(is_response, F.col("payload_bytes")).otherwise(0).cast("string")),
    ]
    headers = described.join(groups.select("content", "first", "parts"), "content").select(
        "key",
        "content",
        "parts",
        F.pmod(F.xxhash64("key", "url"), F.col("parts")).alias("part"),
        target.alias("target"),
        F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).cast("binary").alias("header"),
    )
    headers.write.option("compression", "zstd").parquet(archive.headers)
    kept = spark.read.schema(headers.schema).parquet(archive.headers).filter("target is null")
    content = F.sha2("payload", 256)
    if smallest > 0:  # short payloads are all responses, and still stored once
        kept = kept.groupBy("content").agg(F.min("key").alias("key"), F.max("parts").alias("parts"))
    kept = kept.select("key", F.col("content").alias("own_content"), "parts").distinct()
    bodies = rows.select("key", "payload")
    keyed = bodies.filter("key is not null").withColumn("own_content", content)
    keyed = keyed.join(kept.filter("key is not null"), ["key", "own_content"])
    # The join has dealt the rows by these columns, so dropping repeated ones moves no payload again.
    keyed = keyed.dropDuplicates(["key", "own_content"]).select("own_content", "payload", "parts")
    nameless = bodies.filter("key is null").select(content.alias("own_content"), "payload")
    nameless = nameless.select("own_content", "payload").join(kept.filter("key is null").select("own_content", "parts"), "own_content").dropDuplicates(["own_content"])
    stored = keyed.unionByName(nameless.select("own_content", "payload", "parts")).withColumnRenamed("own_content", "content")
    stored.write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def restore(spark: SparkSession, archive: Archive, key: str = "page_id") -> DataFrame:
    """The original records: one row per header, with the full payload also for revisits.

    Returns ``key``, ``url``, ``record_type``, ``refers_to`` (the key of the response),
    ``payload_bytes``, ``payload_digest``, ``header``, ``payload`` and ``record`` (header, payload
    and end of record as bytes, as a response). Length and digest are computed once per stored
    payload from the bytes that were read, and compared with the digest in the header. Fails if
    a stored payload does not have its digest.
    """
    headers = spark.read.parquet(archive.headers)
    payloads = spark.read.parquet(archive.payloads)
    intact = F.assert_true(F.sha2("payload", 256) == F.col("content"), F.lit("a stored payload is damaged"))
    payloads = payloads.select(
        "content",
        "payload",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(intact.isNull(), base32_sha1(F.col("payload"))).alias("payload_digest"),
        "parts",
    )
    # A payload of many records goes to as many tasks as its records were dealt to.
    payloads = payloads.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).drop("parts")
    head = headers.withColumn("head", F.col("header").cast("string"))
    joined = head.join(payloads, ["content", "part"], "left")
    declared = F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")
    same = F.assert_true(declared == F.col("payload_digest"), F.lit("header and payload disagree"))
    return joined.select(
        F.col("key").alias(key),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        F.col("target").alias("refers_to"),
        "payload_bytes",
        F.when(same.isNull(), F.col("payload_digest")).alias("payload_digest"),
        "header",
        "payload",
        F.concat(F.col("header"), F.col("payload"), F.lit(CRLF + CRLF).cast("binary")).alias("record"),
    )
