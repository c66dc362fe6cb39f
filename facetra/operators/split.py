"""Deterministic splits. They depend on the key only, not on partitions or order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import key_hash
from ..functions.quantiles import order_statistics
from ..functions.scale import lookup_join, small_copy

HASH_DIGITS = 12  # 48 bits: exact in a double


def hash_split(df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: true for a ``test_size`` share of the keys.

    The share is compared with 48 bits of the hash, so small shares are kept as they are.
    """
    cut = math.floor(test_size * 16**HASH_DIGITS)
    return df.withColumn("is_test", key_hash(f"split:{seed}", key, HASH_DIGITS) < cut)


def stratified_split(
    df: DataFrame,
    key: Sequence[str],
    label: str,
    test_size: float = 0.2,
    seed: int = 42,
    **narrowing,
) -> DataFrame:
    """Adds ``is_test`` with ceil(share x n) test rows in every class.

    The cut is the hash value at that rank of the class. It is found by
    counting, so no class is ever sorted in one task; rows then only compare
    their hash with the cut of their class. Rows that share the key at the cut
    share out what is left of the count, in the order of their other columns.
    """
    hashed = df.withColumn("_h", key_hash(f"split:{seed}", key, HASH_DIGITS).cast("double"))
    values = hashed.filter(F.col(label).isNotNull()).select(label, F.col("_h").alias("v"))
    ranks = values.groupBy(label).agg(
        (F.ceil(F.count("*") * test_size) - 1).cast("long").alias("rank"),
        F.count("*").alias("n"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    cuts = order_statistics(values, [label], ranks, **narrowing).select(label, F.col("v").alias("_cut"))
    joined = lookup_join(hashed, cuts, [label], "left")
    below = F.coalesce(F.col("_h") < F.col("_cut"), F.lit(False))
    at = F.coalesce(F.col("_h") == F.col("_cut"), F.lit(False))
    counts = joined.groupBy(label).agg(
        (F.ceil(F.count("*") * test_size) - F.count_if(below)).alias("_left"), F.count_if(at).alias("_at")
    )
    shared = small_copy(counts.filter("_at > _left").select(label, "_left")) or counts.filter("_at > _left").select(label, "_left")
    if shared.isEmpty():
        return joined.withColumn("is_test", below | at).drop("_h", "_cut")
    placed = lookup_join(joined, shared, [label], "left")
    tied = at & F.col("_left").isNotNull()
    order = Window.partitionBy(label).orderBy(F.xxhash64(*[F.col(c) for c in df.columns]))
    rest = placed.filter(~tied).withColumn("is_test", below | at)
    some = placed.filter(tied).withColumn("is_test", F.row_number().over(order) <= F.col("_left"))
    return rest.unionByName(some).drop("_h", "_cut", "_left")


def fold_ids(df: DataFrame, key: Sequence[str], folds: int = 5, seed: int = 42, label: str | None = None) -> DataFrame:
    """Adds ``fold`` (0-based) by the hash of the key.

    With ``label`` every fold holds the same share of each class: folds are cut at
    ranks of the hash within the class. Rows without a label go by the hash alone.
    """
    by_hash = (key_hash(f"fold:{seed}", key, HASH_DIGITS) % folds).cast("int")
    if label is None:
        return df.withColumn("fold", by_hash)
    hashed = df.withColumn("_h", key_hash(f"fold:{seed}", key, HASH_DIGITS).cast("double"))
    values = hashed.filter(F.col(label).isNotNull()).select(label, F.col("_h").alias("v"))
    sizes = values.groupBy(label).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = F.explode(F.sequence(F.lit(1), F.lit(folds - 1))) if folds > 1 else F.lit(1)
    ranks = sizes.withColumn("_i", step).withColumn("rank", F.ceil(F.col("n") * F.col("_i") / folds).cast("long") - 1)
    ranks = ranks.filter("rank >= 0").select(label, "rank", "n", "lo", "hi").distinct()
    found = order_statistics(values, [label], ranks).groupBy(label).agg(F.sort_array(F.collect_list("v")).alias("_cuts"))
    joined = lookup_join(hashed, found, [label], "left")
    fold = F.size(F.filter("_cuts", lambda c: c < F.col("_h")))
    return joined.withColumn("fold", F.when(F.col("_cuts").isNotNull(), fold).otherwise(by_hash)).drop("_h", "_cuts")


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("not is_test").drop("is_test"), df.filter("is_test").drop("is_test")
