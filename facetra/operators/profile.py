"""Descriptive profile of a table: moments, quantiles, outliers, associations."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import (
    cut,
    half_even,
    long_rows,
    numbers,
    ratio,
    safe_corr,
    sample_kurtosis,
    sample_skewness,
)
from ..functions.quantiles import quantiles
from ..functions.scale import cut_lineage, small_copy
from ..spec import TRACKS, FeatureSpec
from .validate import missing_summary

# Tiers of the 0-100 target.
TIER_EDGES = (0, 25, 50, 75, 100)
TIER_LABELS = ("Low", "Medium", "High", "Very High")
FENCE = 1.5


def describe_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and the number of columns of each type, as long rows."""
    types: dict[str, int] = {}
    for _, t in df.dtypes:
        types[t] = types.get(t, 0) + 1
    rows = [("rows", "total", F.col("_n")), ("columns", "total", F.lit(len(df.columns)).cast("long"))]
    rows += [("dtype", t, F.lit(n).cast("long")) for t, n in sorted(types.items())]
    rows += [("position", c, F.lit(i).cast("long")) for i, c in enumerate(df.columns)]
    return long_rows(df.agg(F.count("*").alias("_n")), rows, ("section", "column", "value"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, spec=TRACKS) -> DataFrame:
    """Ten statistics per numeric column; columns without a value are left out."""
    cols = [c for c in (columns or spec.numeric) if c in df.columns]
    data = numbers(df.select(*cols), cols)
    aggs = []
    for c in cols:
        v = F.col(c)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                sample_skewness(v).alias("skewness"),
                sample_kurtosis(v).alias("kurtosis"),
            ).alias(c)
        )
    one = data.agg(*aggs)
    moments = one.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("_m")).select("_m.*")
    q = quantiles(data, cols, (0.25, 0.5, 0.75)).select(
        "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    return moments.filter("count > 0").join(F.broadcast(q), "column")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("count"))
    )


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 10, spec=TRACKS) -> DataFrame:
    """Distinct values and the ``top_n`` most frequent ones per column.

    Ties go to the smaller value. One scan: values become (column, value) rows, which
    are counted, and the ranks are cut per task before they meet. A column without
    values keeps one row with 0 distinct values.
    """
    cols = [c for c in (columns or spec.categorical) if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.inline(pairs)).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))
    counts = small_copy(counts) or cut_lineage(counts)
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value")))
    top = counts.withColumn("rank", place).filter(F.col("rank") <= top_n).withColumn("rank", F.col("rank").cast("long"))
    distinct = counts.groupBy("column").agg(F.count("*").alias("num_unique"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    out = names.join(distinct, "column", "left").join(top, "column", "left").na.fill(0, ["num_unique"])
    return out.select("column", "num_unique", "rank", "value", "count")


def describe_missing(df: DataFrame) -> DataFrame:
    """NULL count and percentage per column; 0.0 on an empty table."""
    one = missing_summary(df)
    n = df.agg(F.count("*").alias("_n"))
    pct = F.coalesce(half_even(ratio(F.col("value") * 100, F.col("_n")), 2), F.lit(0.0))
    total = n.select(F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("column"), "_n")
    return one.join(F.broadcast(total), "column").select(
        "column", F.col("value").alias("count"), pct.alias("percentage")
    )


def detect_outliers(df: DataFrame, columns: Sequence[str] | None = None, spec=TRACKS) -> DataFrame:
    """Values outside the quartile fences per numeric column."""
    cols = [c for c in (columns or spec.numeric) if c in df.columns]
    data = numbers(df.select(*cols), cols)
    fences = {}
    # at most one row per column reaches the driver
    for r in quantiles(data, cols, (0.25, 0.75)).collect():
        q1, q3 = r["q"]
        reach = FENCE * (q3 - q1)
        fences[r["column"]] = (q1 - reach, q3 + reach)
    cols = [c for c in cols if c in fences]
    rows = []
    aggs = []
    for c in cols:
        lo, hi = fences[c]
        aggs += [
            F.count(c).alias(f"n_{c}"),
            F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"k_{c}"),
        ]
        k, n = F.col(f"k_{c}"), F.col(f"n_{c}")
        rows.append(
            (
                c,
                k,
                half_even(ratio(k * 100, n), 2),
                half_even(F.lit(lo), 4),
                half_even(F.lit(hi), 4),
            )
        )
    names = ("column", "count", "percentage", "lower_bound", "upper_bound")
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, count long, percentage double, lower_bound double, upper_bound double"
        )
    return long_rows(data.agg(*aggs), rows, names)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, spec=TRACKS) -> DataFrame:
    """Pairwise-complete Pearson r of every ordered pair, as long rows.

    One pass computes the upper triangle; the lower one is its mirror.
    """
    cols = [c for c in (columns or spec.profile_features) if c in df.columns]
    data = numbers(df.select(*cols), cols)
    pairs = list(combinations(range(len(cols)), 2))
    aggs = [safe_corr(F.col(cols[i]), F.col(cols[j])).alias(f"r_{i}_{j}") for i, j in pairs]
    aggs += [
        F.when(F.min(c) < F.max(c), F.lit(1.0)).alias(f"r_{i}_{i}") for i, c in enumerate(cols)
    ]
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            rows.append((a, b, F.col(f"r_{min(i, j)}_{max(i, j)}")))
    return long_rows(data.agg(*aggs), rows, ("feature_a", "feature_b", "r"))


def target_correlations(df: DataFrame, target: str | None = None, columns=None, spec=TRACKS) -> DataFrame:
    """r of every feature with the target, strongest first; constants are skipped."""
    target = target or spec.target
    schema = "feature string, correlation double"
    if target not in df.columns:
        warnings.warn(f"target column '{target}' not found; returning no correlations", stacklevel=2)
        return df.sparkSession.createDataFrame([], schema)
    cols = [c for c in (columns or spec.profile_features) if c in df.columns and c != target]
    data = numbers(df.select(*cols, target), [*cols, target])
    one = data.agg(*[half_even(safe_corr(F.col(c), F.col(target)), 4).alias(c) for c in cols])
    long = long_rows(one, [(c, F.col(c)) for c in cols], ("feature", "correlation"))
    return long.filter("correlation is not null").orderBy(F.abs("correlation").desc(), "feature")


def category_summary(df: DataFrame, columns: Sequence[str] | None = None, spec=TRACKS) -> DataFrame:
    """Count, mean and sample deviation of every feature per category."""
    category = spec.category
    if category not in df.columns:
        warnings.warn(f"'{category}' column missing; returning an empty summary", stacklevel=2)
        return df.sparkSession.createDataFrame([], f"{category} string")
    cols = [c for c in (columns or spec.profile_features) if c in df.columns]
    data = numbers(df.select(category, *cols), cols).filter(F.col(category).isNotNull())
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}_count"),
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_std"),
        ]
    return data.groupBy(category).agg(*aggs)


def tier_pivot(
    df: DataFrame,
    edges: Sequence[float] = TIER_EDGES,
    labels: Sequence[str] = TIER_LABELS,
    spec: FeatureSpec = TRACKS,
) -> DataFrame:
    """Rows per category and target tier. All tiers are columns, zero-filled.

    Conditional counts rather than ``pivot``: the tiers are known, so one
    aggregate does it, and a tier nobody falls into still gets its column.
    """
    missing = [c for c in (spec.category, spec.target) if c not in df.columns]
    if missing:
        warnings.warn(f"columns {missing} missing; returning an empty pivot", stacklevel=2)
        return df.sparkSession.createDataFrame([], f"{spec.category} string")
    data = numbers(df.select(spec.category, spec.target), [spec.target])
    tier = cut(F.col(spec.target), list(edges))
    placed = data.select(spec.category, tier.alias("_t")).filter(
        F.col(spec.category).isNotNull() & F.col("_t").isNotNull()
    )
    return placed.groupBy(spec.category).agg(
        *[F.count_if(F.col("_t") == i).alias(label) for i, label in enumerate(labels)]
    )


def summarize(df: DataFrame, spec: FeatureSpec = TRACKS) -> dict[str, DataFrame]:
    """All profile tables by name; each is lazy and small."""
    return {
        "shape": describe_shape(df),
        "numeric": describe_numeric(df, spec=spec),
        "categorical": describe_categorical(df, spec=spec),
        "missing": describe_missing(df),
        "outliers": detect_outliers(df, spec=spec),
        "correlation_matrix": correlation_matrix(df, spec=spec),
        "target_correlations": target_correlations(df, spec=spec),
        "category_summary": category_summary(df, spec=spec),
        "tier_pivot": tier_pivot(df, spec=spec),
    }


def local(df: DataFrame) -> DataFrame:
    """Materialise a small result once, so that several sinks do not recompute it."""
    return small_copy(df) or df
