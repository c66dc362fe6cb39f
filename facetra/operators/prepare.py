"""Preparation of model input: imputation, encoding, labels, weights, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import key_hash, long_rows, numbers
from ..functions.quantiles import quantiles
from ..functions.scale import constants, lookup_join, small_copy
from ..spec import TRACKS, FeatureSpec, require_columns

UNKNOWN = "unknown"  # fixed value: category of rows that have none
NOT_HIT, HIT = 0, 1
ORDER_DIGITS, ORDER_BLOCKS = 12, 4_096  # hash digits that order rows, and blocks of that order
MAX_LABELS = 100_000  # classes that an encoding or a classifier may have


def validate_input(df: DataFrame, columns: Sequence[str]) -> None:
    if df.isEmpty():
        raise ValueError("there are no rows to model")
    require_columns(df, columns)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact interpolated medians; at most one row per column is collected."""
    return {r["column"]: r["q"][0] for r in quantiles(df, columns, (0.5,)).collect()}


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def _imputed(df: DataFrame, spec: FeatureSpec) -> list[str]:
    return [c for c in spec.numeric if c in df.columns and c != spec.target]


def impute_regression(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Drop rows without a target; unknown category; medians for the numbers."""
    cols = _imputed(df, spec)
    data = numbers(df, [*cols, spec.target]).na.drop(subset=[spec.target])
    data = data.na.fill(UNKNOWN, [spec.category])
    return fill(data, medians(data, cols))


def impute_classification(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Drop rows without a target; flag defaults to false; medians for the numbers."""
    cols = _imputed(df, spec)
    data = numbers(df, [*cols, spec.target]).na.drop(subset=[spec.target])
    if spec.flag and spec.flag in df.columns:
        data = data.withColumn(spec.flag, F.coalesce(F.col(spec.flag).cast("boolean"), F.lit(False)))
    return fill(data, medians(data, cols))


def impute_from_train(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill both splits with medians of the train rows (``is_test`` false)."""
    data = numbers(df, columns)
    return fill(data, medians(data.filter("not is_test"), columns))


def numeric_flag(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """The flag as 0/1; missing counts as 0."""
    if not spec.flag or spec.flag not in df.columns:
        return df
    return df.withColumn(spec.flag, F.coalesce(F.col(spec.flag).cast("boolean"), F.lit(False)).cast("int"))


def drop_identifiers(df: DataFrame, spec: FeatureSpec = TRACKS, keep: Sequence[str] = ()) -> DataFrame:
    gone = [c for c in (*spec.text, "Unnamed: 0", "_c0") if c not in keep]
    return df.drop(*gone)


def labels_of(df: DataFrame, column: str, most: int = MAX_LABELS) -> list[str]:
    """Sorted distinct labels; refuses more than ``most``, which models could not hold."""
    local = small_copy(df.filter(F.col(column).isNotNull()).select(column).distinct(), most)
    if local is None:
        raise ValueError(f"'{column}' has more than {most} values; it is not a category")
    return sorted(r[0] for r in local.collect())


def dummies(df: DataFrame, column: str, labels: Sequence[str], drop_first: bool = True) -> DataFrame:
    """0/1 column per label. Unseen labels and the dropped first one are all zero."""
    kept = list(labels)[1:] if drop_first else list(labels)
    flags = {
        f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in kept
    }
    return df.withColumns(flags).drop(column)


def encoder(column: str, labels: Sequence[str], drop_first: bool = True) -> list:
    """ML stages of the same encoding; unseen labels become the zero vector."""
    kept = list(labels)[1:] if drop_first else list(labels)
    index = StringIndexerModel.from_labels(
        kept or [UNKNOWN], inputCol=column, outputCol=f"{column}_index", handleInvalid="keep"
    )
    # "keep" puts the unseen labels in the last slot, which dropLast removes
    return [index, OneHotEncoder(inputCol=f"{column}_index", outputCol=f"{column}_vec", dropLast=True)]


def ordered_statistic(df: DataFrame, category: str, target: str, key: Sequence[str], out: str, prior_rows: float = 1.0, seed: int = 42) -> DataFrame:
    """Adds ``out``: the mean target of the earlier rows of the row's category, drawn to the mean of all.

    Rows go in the order of a hash of ``key``, so no row sees its own target: with ``n`` rows
    before it that sum to ``s``, a row gets (s + prior_rows x mean of all) / (n + prior_rows). Rows of
    one hash do not see each other. Rows without a category are one category, those without a target
    count for nothing. Sums are taken in ``ORDER_BLOCKS`` blocks of hashes first, then before each block, then
    within it, so that a category with most of the rows is as many tasks as there are blocks.
    """
    mean = constants(df, m=F.avg(F.col(target).cast("double")))["m"]
    at, block, label = f"_{out}_at", f"_{out}_block", f"_{out}_label"
    value = F.col(target).cast("double")
    rows = df.withColumn(at, key_hash(f"order:{seed}", key, ORDER_DIGITS))
    rows = rows.withColumns({block: F.floor(F.col(at) / (16**ORDER_DIGITS // ORDER_BLOCKS)), label: F.coalesce(F.col(category).cast("string"), F.lit(UNKNOWN))})
    blocks = rows.groupBy(label, block).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_s"), F.count(value).alias("_n"))
    before = Window.partitionBy(label).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(label, block, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_s", "_n")])
    within = Window.partitionBy(label, block).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_s": F.coalesce(F.sum(value).over(within), F.lit(0.0)), "_n": F.count(value).over(within)})
    rows = rows.join(blocks, [label, block])
    total, count = F.col("_s_before") + F.col("_s"), F.col("_n_before") + F.col("_n")
    drawn = (total + F.lit(prior_rows * mean if mean is not None else None).cast("double")) / (count + F.lit(prior_rows))
    return rows.withColumn(out, drawn).select(*df.columns, out)


def category_statistic(df: DataFrame, category: str, target: str, out: str, prior_rows: float = 1.0) -> SQLTransformer:
    """A stage that adds ``out`` to rows to be scored: the same mean over all rows of ``df``.

    A category that ``df`` does not have gets the mean of all rows.
    """
    value = F.col(target).cast("double")
    label = F.coalesce(F.col(category).cast("string"), F.lit(UNKNOWN)).alias("label")
    groups = df.groupBy(label).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.count(value).alias("n"))
    local = small_copy(groups, MAX_LABELS)
    if local is None:
        raise ValueError(f"'{category}' has more than {MAX_LABELS} values; it is not a category")
    found = local.collect()
    n = sum(r["n"] for r in found)
    mean = sum(r["s"] for r in found) / n if n else 0.0
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = ", ".join(f"{quoted(r['label'])}, {float((r['s'] + prior_rows * mean) / (r['n'] + prior_rows))!r}D" for r in found)
    asked = f"coalesce(CAST(`{category}` AS STRING), {quoted(UNKNOWN)})"
    held = f"try_element_at(map({pairs}), {asked})" if found else "CAST(NULL AS DOUBLE)"
    return SQLTransformer(statement=f"SELECT *, coalesce({held}, {float(mean)!r}D) AS `{out}` FROM __THIS__")


def keep_frequent(df: DataFrame, label: str, min_rows: int = 50) -> DataFrame:
    """Rows whose label occurs at least ``min_rows`` times."""
    frequent = (
        df.filter(F.col(label).isNotNull()).groupBy(label).count().filter(F.col("count") >= min_rows)
    ).select(label)
    if frequent.isEmpty():
        raise ValueError(f"no '{label}' has at least {min_rows} rows")
    return lookup_join(df, frequent, [label], "left_semi")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = n / (classes x rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    counts = small_copy(counts) or counts
    all_ = constants(counts, n=F.sum("_n"), k=F.count("*"))
    if not all_["k"]:
        raise ValueError(f"'{label}' has no values")
    weighted = counts.select(label, (F.lit(all_["n"] / all_["k"]) / F.col("_n")).alias("weight"))
    return lookup_join(df, weighted, [label], "left")


def hit_label(df: DataFrame, threshold: float = 70, spec: FeatureSpec = TRACKS) -> DataFrame:
    hit = F.coalesce(F.col(spec.target) >= threshold, F.lit(False)).cast("int")
    return df.withColumn("is_hit", hit)


def hit_profiles(df: DataFrame, features: Sequence[str] | None = None, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Mean feature vector of each class; both classes must occur."""
    cols = list(features or spec.class_features)
    means = df.groupBy("is_hit").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    local = small_copy(means, 2)
    if local is None or local.count() < 2:
        raise ValueError("profiles need rows of both classes")
    return local


def profile_differences(profiles: DataFrame) -> DataFrame:
    """Per feature: class means and their difference, largest first."""
    cols = [c for c in profiles.columns if c != "is_hit"]
    one = profiles.agg(
        *[
            F.max(F.when(F.col("is_hit") == k, F.col(c))).alias(f"m{k}_{c}")
            for c in cols
            for k in (NOT_HIT, HIT)
        ]
    )
    rows = [(c, F.col(f"m{NOT_HIT}_{c}"), F.col(f"m{HIT}_{c}")) for c in cols]
    long = long_rows(one, rows, ("feature", "non_hit_mean", "hit_mean"))
    gap = F.col("hit_mean") - F.col("non_hit_mean")
    return (
        long.withColumn("difference", gap)
        .withColumn("absolute_difference", F.abs("difference"))
        .withColumn(
            "direction",
            F.when(gap > 0, F.lit("higher in hits")).otherwise(F.lit("lower in hits")),
        )
        .orderBy(F.desc("absolute_difference"), "feature")
    )


def similarity_features(df: DataFrame, profiles: DataFrame, scaled: bool = False) -> DataFrame:
    """Euclidean distance to both class profiles and what derives from it.

    ``profiles`` should come from train rows. ``scaled`` divides each feature by
    its deviation first, so that large-valued features do not dominate.
    """
    cols = [c for c in profiles.columns if c != "is_hit"]
    centre = {r["is_hit"]: r for r in profiles.collect()}  # two rows
    unit = dict.fromkeys(cols, 1.0)
    if scaled:
        got = constants(df, **{c: F.stddev_pop(F.col(c).cast("double")) for c in cols})
        unit = {c: got[c] or 1.0 for c in cols}

    def distance(k: int):
        squares = [
            ((F.col(c).cast("double") - F.lit(centre[k][c])) / F.lit(unit[c])) ** 2 for c in cols
        ]
        return F.sqrt(reduce(lambda a, b: a + b, squares))

    near = df.withColumns(
        {"distance_to_non_hit": distance(NOT_HIT), "distance_to_hit": distance(HIT)}
    )
    return near.withColumns(
        {
            "hit_distance_advantage": F.col("distance_to_non_hit") - F.col("distance_to_hit"),
            "hit_closeness_ratio": F.col("distance_to_hit") / (F.col("distance_to_non_hit") + 1e-9),
        }
    )


SIMILARITY = (
    "distance_to_non_hit",
    "distance_to_hit",
    "hit_distance_advantage",
    "hit_closeness_ratio",
)


def modeling_frame(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    return df.select(*key, *SIMILARITY, "is_hit")


def comparison_data(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Complete rows with a positive target, for the three-model comparison."""
    require_columns(df, [spec.target])
    category = spec.resolve_category(df)
    cols = [c for c in spec.profile_features if c in df.columns]
    key = [k for k in spec.key if k in df.columns]
    data = numbers(df.select(*key, *cols, *([category] if category else []), spec.target), [*cols, spec.target])
    used = [*cols, *([category] if category else []), spec.target]
    return data.na.drop(subset=used).filter(F.col(spec.target) > 0)
