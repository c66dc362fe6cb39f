"""Analysis: unusual rows per category, associations, category comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import (
    cut,
    half_even,
    long_rows,
    no_nan,
    numbers,
    ratio,
    safe_corr,
)
from ..functions.scale import MAX_LOOKUP_ROWS, constants, lookup_join
from ..functions.stats import bootstrap_intervals, correlation_p_value, holm_adjust
from ..spec import TRACKS, FeatureSpec, require_columns
from .profile import local

# Smallest |r| of each strength label.
STRENGTHS = ((0.7, "strong"), (0.4, "moderate"), (0.2, "weak"))
WEAKEST = "very weak"


def category_stats(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Mean and sample deviation of each feature per category."""
    aggs = []
    for f in spec.features:
        v = no_nan(F.col(f).cast("double"))
        aggs += [F.avg(v).alias(f"{f}_group_mean"), F.stddev_samp(v).alias(f"{f}_group_std")]
    return df.filter(F.col(spec.category).isNotNull()).groupBy(spec.category).agg(*aggs)


def enrich(df: DataFrame, spec: FeatureSpec = TRACKS, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Every row with the mean and deviation of its category; no row is lost.

    The statistics are aggregated once and looked up, so the rows themselves are
    never shuffled and a category with a third of them costs nothing extra.
    """
    require_columns(df, (spec.category, *spec.features))
    return lookup_join(df, category_stats(df, spec), [spec.category], "left", max_rows)


def deviations(df: DataFrame, spec: FeatureSpec = TRACKS, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """z-scores within the category and their mean absolute value per row."""
    rich = enrich(df, spec, max_rows)
    z = {}
    for f in spec.features:
        gap = no_nan(F.col(f).cast("double")) - F.col(f"{f}_group_mean")
        z[f] = ratio(gap, F.nullif(F.col(f"{f}_group_std"), F.lit(0.0)))
    rich = rich.withColumns({f"_z_{f}": e for f, e in z.items()})
    sizes = [F.abs(F.col(f"_z_{f}")) for f in spec.features]
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in sizes])
    known = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in sizes])
    out = {"deviation_score": half_even(ratio(total, known), 4)}
    out |= {f"{f}_zscore": half_even(F.col(f"_z_{f}"), 4) for f in spec.features}
    return rich.withColumns(out).drop(*[f"_z_{f}" for f in spec.features])


def _over(df: DataFrame, threshold: float, spec: FeatureSpec) -> DataFrame:
    shown = [*spec.key, *[c for c in (spec.name, spec.owner) if c], spec.category, spec.target]
    scored = deviations(df, spec).select(*shown, "deviation_score")
    # compares the rounded score
    return scored.filter(F.col("deviation_score") > threshold)


def outliers(df: DataFrame, threshold: float = 2.0, top_n: int = 20, spec: FeatureSpec = TRACKS) -> DataFrame:
    """The ``top_n`` rows that deviate most from their category."""
    return _over(df, threshold, spec).orderBy(F.desc("deviation_score"), *spec.key).limit(top_n)


def outlier_total(df: DataFrame, threshold: float = 2.0, spec: FeatureSpec = TRACKS) -> DataFrame:
    """How many rows exceed the threshold, beyond those the report shows."""
    return _over(df, threshold, spec).agg(
        F.count("*").alias("outliers"), F.max("deviation_score").alias("max_score")
    )


def correlations(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """r with the target per feature; features with n < 3 or constant are left out."""
    target = spec.target
    require_columns(df, (*spec.features, target))
    data = numbers(df.select(*spec.features, target), [*spec.features, target])
    t = F.col(target)
    aggs = []
    for f in spec.features:
        both = F.col(f).isNotNull() & t.isNotNull()
        aggs += [safe_corr(F.col(f), t).alias(f"r_{f}"), F.count_if(both).alias(f"n_{f}")]
    rows = [(f, F.col(f"r_{f}"), F.col(f"n_{f}")) for f in spec.features]
    long = long_rows(data.agg(*aggs), rows, ("feature", "r", "n"))
    return long.filter("n >= 3 and r is not null")


def describe_correlations(found: DataFrame) -> DataFrame:
    """Rounded r, direction and strength label."""
    size = F.abs("r")
    label = F.lit(WEAKEST)
    for low, name in reversed(STRENGTHS):
        label = F.when(size >= low, F.lit(name)).otherwise(label)
    return found.select(
        "feature",
        half_even(F.col("r"), 4).alias("correlation"),
        half_even(size, 4).alias("abs_correlation"),
        F.when(F.col("r") > 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction"),
        label.alias("strength"),
        "n",
    )


def infer_correlations(
    df: DataFrame,
    n_bootstrap: int = 1000,
    alpha: float = 0.05,
    random_state: int | None = 42,
    spec: FeatureSpec = TRACKS,
) -> DataFrame:
    """Correlations with interval, p-value and Holm-adjusted significance."""
    found = correlations(df, spec)
    described = describe_correlations(found)
    p = found.select("feature", correlation_p_value(F.col("r"), F.col("n").cast("double")).alias("p_value"))
    data = numbers(df.select(*spec.key, *spec.features, spec.target), [*spec.features, spec.target])
    ci = bootstrap_intervals(
        data, spec.features, spec.target, spec.key, n_bootstrap, alpha, random_state
    )
    ci = ci.select("feature", half_even(F.col("ci_low"), 4).alias("ci_low"), half_even(F.col("ci_high"), 4).alias("ci_high"))
    # one row per feature on every side
    joined = described.join(F.broadcast(p), "feature").join(F.broadcast(ci), "feature", "left")
    tested = holm_adjust(joined)
    return tested.select(
        "feature",
        "correlation",
        "abs_correlation",
        "direction",
        "strength",
        "ci_low",
        "ci_high",
        "p_value",
        "p_value_adjusted",
        (F.col("p_value_adjusted") < alpha).alias("significant"),
        "n",
    ).orderBy(F.desc("abs_correlation"), "feature")


def compare_categories(df: DataFrame, top_n: int = 10, spec: FeatureSpec = TRACKS) -> DataFrame:
    """The most frequent categories with their mean target and features."""
    data = numbers(df.select(spec.category, spec.target, *spec.features), [spec.target, *spec.features])
    means = [half_even(F.avg(f), 4).alias(f"avg_{f}") for f in spec.features]
    grouped = data.filter(F.col(spec.category).isNotNull()).groupBy(
        F.col(spec.category).alias("category")
    )
    table = grouped.agg(
        F.count("*").alias("row_count"), half_even(F.avg(spec.target), 1).alias("avg_target"), *means
    )
    return table.orderBy(F.desc("row_count"), "category").limit(top_n)


def contrasts(compared: DataFrame, metrics=None) -> DataFrame:
    """Per metric the category with the largest and with the smallest value."""
    metrics = metrics or [c for c in compared.columns if c.startswith("avg_")]

    def end(m: str, sign: int):
        return F.min(F.struct((F.col(m) * sign).alias("v"), F.col("category").alias("c")))

    aggs = [end(m, -1).alias(f"most_{m}") for m in metrics] + [
        end(m, 1).alias(f"least_{m}") for m in metrics
    ]
    rows = [
        (m, F.col(f"most_{m}.c"), -F.col(f"most_{m}.v"), F.col(f"least_{m}.c"), F.col(f"least_{m}.v"))
        for m in metrics
    ]
    return long_rows(
        compared.agg(*aggs), rows, ("metric", "most", "most_value", "least", "least_value")
    )


def directions(table: DataFrame) -> DataFrame:
    """Features listed by direction, with how many are significant."""
    by = table.groupBy("direction").agg(
        F.array_join(F.array_sort(F.collect_list("feature")), ", ").alias("features"),
        F.count_if(F.col("significant")).alias("significant"),
        F.count("*").alias("total"),
    )
    return by


def feature_buckets(df: DataFrame, feature: str, n_buckets: int = 5, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Mean target in equal-width buckets of a feature; empty buckets are kept."""
    if feature not in df.columns:
        raise ValueError(f"feature '{feature}' not in DataFrame; it has {sorted(df.columns)}")
    require_columns(df, [spec.target])
    if n_buckets < 1:
        raise ValueError(f"n_buckets must be >= 1, got {n_buckets}")
    data = numbers(df.select(feature, spec.target), [feature, spec.target]).na.drop()
    ends = constants(data, lo=F.min(feature), hi=F.max(feature))
    spark = df.sparkSession
    lo, hi = ends["lo"], ends["hi"]
    if lo is None:
        return spark.createDataFrame(
            [], "bucket_id long, bucket string, avg_target double, row_count long"
        )
    if lo == hi:
        edges, slot = [lo, hi], F.lit(0)
    else:
        step = (hi - lo) / n_buckets
        edges = [lo + i * step for i in range(n_buckets)] + [hi]
        slot = cut(F.col(feature), edges)
    counted = data.groupBy(slot.cast("long").alias("bucket_id")).agg(
        half_even(F.avg(spec.target), 2).alias("avg_target"), F.count("*").alias("row_count")
    )
    names = [(i, f"{edges[i]:.2f}-{edges[i + 1]:.2f}") for i in range(len(edges) - 1)]
    every = spark.createDataFrame(names, "bucket_id long, bucket string")
    # at most n_buckets rows on either side
    full = every.join(F.broadcast(counted), "bucket_id", "left")
    return full.select(
        "bucket_id", "bucket", "avg_target", F.coalesce("row_count", F.lit(0)).alias("row_count")
    ).orderBy("bucket_id")


def category_extremes(df: DataFrame, n: int = 5, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Categories with the highest and the lowest mean target."""
    data = numbers(df.select(spec.category, spec.target), [spec.target])
    means = (
        data.filter(F.col(spec.category).isNotNull())
        .groupBy(F.col(spec.category).alias("category"))
        .agg(F.avg(spec.target).alias("avg_target"), F.count("*").alias("row_count"))
        .filter("avg_target is not null")
    )
    top = means.orderBy(F.desc("avg_target"), "category").limit(n).withColumn("side", F.lit("top"))
    low = means.orderBy("avg_target", "category").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def flag_means(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Mean target with and without the flag."""
    data = numbers(df.select(spec.flag, spec.target), [spec.target])
    return (
        data.filter(F.col(spec.flag).isNotNull())
        .groupBy(spec.flag)
        .agg(F.avg(spec.target).alias("avg_target"), F.count("*").alias("row_count"))
    )


def run_analysis(df: DataFrame, spec: FeatureSpec = TRACKS, n_bootstrap: int = 1000) -> dict:
    """All analysis tables; the rows are enriched once."""
    table = local(infer_correlations(df, n_bootstrap=n_bootstrap, spec=spec))
    strongest = [r["feature"] for r in table.orderBy(F.desc("abs_correlation"), "feature").limit(3).collect()]
    return {
        "correlations": table,
        "category_comparison": compare_categories(df, spec=spec),
        "outliers": outliers(df, spec=spec),
        "enriched": enrich(df, spec),
        "feature_buckets": {f: feature_buckets(df, f, spec=spec) for f in strongest},
    }
