"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the folder that all executors share.

    Later steps read the table, so a lost executor costs no recomputation of what
    led to it, and costly columns are computed once.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows, so that whole texts fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def named(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores in front until no column of the input has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def remainder(column: Column, divisor: int) -> Column:
    """crc32 of the column as text, modulo ``divisor`` (null when the column is null)."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def column(name: str) -> Column:
    return F.col(f"`{name}`")
