"""A training-data pipeline over ``documents``: each stage calls one operator of the subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetra.llm import byte_bpe, language, mixing, order_minhash, suffix_dedup
from facetra.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``lang`` is the declaration, the source stands for a host."""
    model = language.fit_text_model(docs)
    found = language.identify(
        docs, model, "doc_id", F.col("text"), host=F.col("source"), declared=F.col("lang"), keep=["text", "lang", "source", "n_chars"]
    )
    return found.filter(F.col("language") != language.UNDETERMINED).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows without an id are groups of their own. Rows that repeat an id and a text stay once.
    """
    found = order_minhash.near_duplicates(docs)
    kept = found.filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    kept = written(kept, "kept")
    out = docs.filter("doc_id is not null").join(kept, "doc_id")
    once = out.filter("rows = 1").select(*COLUMNS)
    repeated = out.filter("rows > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur elsewhere too.

    Fifty words of these texts have about 317 bytes (6.3 a word with its blank), so a passage of
    over 50 words that repeats is longer than 200 bytes, also where words are short.
    A cut within a character takes the whole character; ``n_chars`` is counted anew.
    """
    found = suffix_dedup.dedup(docs, length=200, carry=["lang", "source"])
    mended = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.col("n_removed") > 0, mended).otherwise(F.col("kept").cast("string"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: never, once, or once per pass."""
    taken = mixing.mixed(docs, entropy=0.98, max_passes=4.0).select(F.col("doc_id").alias("taken"), "pass").distinct()
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col("taken"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document as digests, with the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_digests(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language", identify),
    ("near_duplicates", near),
    ("suffix_dedup", without_repeats),
    ("mixing", mix),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
