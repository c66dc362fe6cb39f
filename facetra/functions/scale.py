"""Helpers that keep small results small: every broadcast passes a size check."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have to be broadcast. At ~30 doubles a row this is 25 MB.
MAX_LOOKUP_ROWS = 100_000
# Rows of one key that a task of a salted join takes.
SALT_ROWS = 1_000_000
MAX_SALTS = 4_096
# Rows of a task of an iterative fit, and partitions that are few enough to stay as they are.
TASK_ROWS = 50_000
FEW_TASKS = 8
# Tasks that keep a cluster's cores busy, beyond which those of an iterative fit get more rows, up to so many.
MANY_TASKS, MOST_TASK_ROWS = 24, 200_000


def constants(df: DataFrame, **aggregates: Column) -> dict[str, Any]:
    """Global aggregates as Python values: one job, one row.

    Operators embed them as literals, which keeps the following projection
    free of joins and lets filters on them reach the Parquet scan.
    """
    return df.agg(*[v.alias(k) for k, v in aggregates.items()]).first().asDict()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: the one the cluster names.

    Where none is named, a folder in the warehouse is taken in local mode, and an error
    raised on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/facetra-shared"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def compact(df: DataFrame, rows: int = TASK_ROWS, few: int = 1) -> DataFrame:
    """``df`` kept in as many partitions as hold ``rows`` rows each, or in its own where those are fewer.

    For fits that pass over the same rows hundreds of times: a pass costs one task a partition, and the
    partitions of a small join are many and nearly empty. More than ``MANY_TASKS`` only come where they would
    hold over ``MOST_TASK_ROWS`` rows. Up to ``few`` partitions stay: random draws of
    MLlib's k-means follow them. The caller unpersists the result.
    """
    held = df.persist()
    n = held.count()
    tasks = max(1, min(math.ceil(n / rows), MANY_TASKS), math.ceil(n / MOST_TASK_ROWS))
    if held.rdd.getNumPartitions() <= max(tasks, few):
        return held
    dense = held.coalesce(tasks).persist()
    dense.count()
    held.unpersist()
    return dense


def side_by_side(work: Callable, items: Sequence, threads: int) -> list:
    """``work`` of every item, some at a time; Spark runs their jobs side by side."""
    if threads <= 1 or len(items) < 2:
        return [work(i) for i in items]
    with ThreadPoolExecutor(min(threads, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), items))


def small_table(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> pa.Table | None:
    """The rows of ``df``, or None when there are more than ``max_rows``.

    ``limit`` bounds what the driver receives whatever the size of ``df``.
    """
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def local_frame(table: pa.Table, like: DataFrame) -> DataFrame:
    """A DataFrame over rows the driver holds, with the columns of ``like``."""
    spark = like.sparkSession
    schema = like.select(*table.column_names).schema
    out = spark.createDataFrame(table, schema) if table.num_rows else spark.createDataFrame([], schema)
    out._facetra_rows = table.num_rows
    return out


def small_copy(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame | None:
    """A local copy of ``df``, or None when it has more than ``max_rows`` rows."""
    if df.__dict__.get("_facetra_rows", max_rows + 1) <= max_rows:
        return df
    table = small_table(df, max_rows)
    return None if table is None else local_frame(table, df)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = MAX_LOOKUP_ROWS,
    salts: int | None = None,
) -> DataFrame:
    """Attach per-group values to rows without shuffling the rows.

    Up to ``max_rows`` rows ``small`` is broadcast. Beyond that (its first rows have
    then been computed to find out) the join is shuffled with a salt: rows are dealt to
    salts by their position, so that equal rows spread too, and the per-group
    side is repeated once per salt. The number of salts follows from the largest group.
    """
    on = list(on)
    columns = list(big.columns)
    if how not in ("left_semi", "left_anti"):
        columns += [c for c in small.columns if c not in on]
    local = small_copy(small, max_rows)
    if local is not None:
        return big.join(F.broadcast(local), on, how).select(*columns)
    if salts is None:
        largest = big.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
        salts = min(MAX_SALTS, math.ceil(largest / SALT_ROWS) or 1)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        big.withColumn("_salt", salt)
        .join(small.withColumn("_salt", every_salt), [*on, "_salt"], how)
        .select(*columns)
    )
