"""The tables behind the charts: each returns a small DataFrame to draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import (
    key_hash,
    long_rows,
    numbers,
    ratio,
    safe_corr,
    search_tree,
)
from ..functions.quantiles import quantiles
from ..functions.scale import constants, lookup_join
from ..spec import TRACKS, FeatureSpec, require_columns
from .analyze import infer_correlations
from .metrics import regression_metrics
from .profile import correlation_matrix

WHISKER = 1.5  # fixed value: reach of the whiskers in quartile ranges


def top_categories(df: DataFrame, top_n: int = 10, spec: FeatureSpec = TRACKS) -> DataFrame:
    """The most frequent categories, smallest first for a bar chart."""
    require_columns(df, [spec.category])
    counts = (
        df.filter(F.col(spec.category).isNotNull())
        .groupBy(F.col(spec.category).cast("string").alias("category"))
        .agg(F.count("*").alias("row_count"))
    )
    top = counts.orderBy(F.desc("row_count"), "category").limit(top_n)
    return top.orderBy("row_count", F.desc("category"))


def histogram(df: DataFrame, column: str | None = None, bins: int = 20, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Equal-width bins, left-closed, the last one closed; empty bins are kept."""
    column = column or spec.target
    require_columns(df, [column])
    data = numbers(df.select(column), [column]).na.drop()
    ends = constants(data, lo=F.min(column), hi=F.max(column))
    lo, hi = ends["lo"], ends["hi"]
    spark = df.sparkSession
    schema = "bin long, bin_low double, bin_high double"
    if lo is None:
        return spark.createDataFrame([], f"{schema}, row_count long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    edges = [lo + i * step for i in range(bins)] + [hi]
    at = F.least(search_tree(F.col(column), edges, right_closed=False), F.lit(bins - 1))
    counts = data.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("row_count"))
    every = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], schema)
    full = every.join(F.broadcast(counts), "bin", "left")  # at most ``bins`` rows
    return full.na.fill(0, ["row_count"]).orderBy("bin")


def correlation_bars(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """r per feature, 0.0 below two complete rows, ascending, with its sign."""
    require_columns(df, (*spec.features, spec.target))
    data = numbers(df.select(*spec.features, spec.target), [*spec.features, spec.target])
    t = F.col(spec.target)
    aggs = []
    for f in spec.features:
        n = F.count_if(F.col(f).isNotNull() & t.isNotNull())
        aggs.append(F.when(n < 2, F.lit(0.0)).otherwise(safe_corr(F.col(f), t)).alias(f))
    long = long_rows(data.agg(*aggs), [(f, F.col(f)) for f in spec.features], ("feature", "r"))
    return long.withColumn("negative", F.col("r") < 0).orderBy(F.asc_nulls_last("r"), "feature")


def correlation_forest(df: DataFrame, n_bootstrap: int = 1000, alpha: float = 0.05, random_state: int | None = 42, spec: FeatureSpec = TRACKS) -> DataFrame:
    """r with the lengths of its interval arms, weakest first."""
    table = infer_correlations(df, n_bootstrap, alpha, random_state, spec)
    if table.isEmpty():
        raise ValueError("No features available for the correlation forest.")
    return table.select(
        "feature",
        "correlation",
        "abs_correlation",
        (F.col("correlation") - F.col("ci_low")).alias("arm_low"),
        (F.col("ci_high") - F.col("correlation")).alias("arm_high"),
        F.coalesce("significant", F.lit(False)).alias("significant"),
    ).orderBy("abs_correlation", "feature")


def _most_frequent(df: DataFrame, category: str, n: int) -> list:
    """Names of the ``n`` most frequent categories; ``n`` rows are collected."""
    counts = df.groupBy(category).agg(F.count("*").alias("_n"))
    return [r[0] for r in counts.orderBy(F.desc("_n"), category).limit(n).collect()]


def category_targets(df: DataFrame, top_n: int = 15, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Mean and deviation of the target in the most frequent categories."""
    require_columns(df, [spec.category, spec.target])
    data = numbers(df.select(spec.category, spec.target), [spec.target]).na.drop()
    stats = data.groupBy(F.col(spec.category).alias("category")).agg(
        F.count("*").alias("row_count"),
        F.avg(spec.target).alias("mean_target"),
        F.stddev_samp(spec.target).alias("std_target"),
    )
    top = stats.orderBy(F.desc("row_count"), "category").limit(top_n)
    return top.orderBy(F.desc("mean_target"), "category")


def heatmap(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    require_columns(df, spec.features)
    return correlation_matrix(df, spec.features, spec)


def hit_profiles_scaled(df: DataFrame, threshold: float = 70, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Min-max scaled feature means of hits and others; constants stay unscaled."""
    require_columns(df, (*spec.features, spec.target))
    data = numbers(df.select(*spec.features, spec.target), [*spec.features, spec.target])
    data = data.na.drop(subset=[spec.target])
    ends = constants(
        data,
        **{f"lo_{f}": F.min(f) for f in spec.features},
        **{f"hi_{f}": F.max(f) for f in spec.features},
    )
    hit = F.col(spec.target) >= threshold
    aggs = []
    for f in spec.features:
        lo, hi = ends[f"lo_{f}"], ends[f"hi_{f}"]
        v = F.col(f)
        if lo is not None and hi > lo:
            v = (v - F.lit(lo)) / F.lit(hi - lo)
        aggs += [F.avg(F.when(hit, v)).alias(f"h_{f}"), F.avg(F.when(~hit, v)).alias(f"o_{f}")]
    rows = [(f, F.col(f"h_{f}"), F.col(f"o_{f}")) for f in spec.features]
    return long_rows(data.agg(*aggs), rows, ("feature", "hit_mean", "non_hit_mean"))


def scatter(df: DataFrame, x: str = "energy", y: str = "danceability", sample: int = 2000, seed: int = 42, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Complete (x, y, target) rows; a fixed sample of them when there are more."""
    cols = [x, y, spec.target]
    require_columns(df, cols)
    data = numbers(df.select(*spec.key, *cols), cols).na.drop(subset=cols)
    return data.orderBy(key_hash(seed, spec.key), *spec.key).limit(sample)


def importance_bars(importance: DataFrame, top_n: int = 10) -> DataFrame:
    require_columns(importance, ["feature", "importance"])
    top = importance.orderBy(F.desc("importance"), "feature").limit(top_n)
    return top.orderBy("importance", F.desc("feature"))


def _in_top(df: DataFrame, feature: str, top_n: int, spec: FeatureSpec) -> DataFrame:
    require_columns(df, [spec.category, feature])
    data = numbers(df.select(spec.category, feature), [feature]).na.drop()
    return data.filter(F.col(spec.category).isin(_most_frequent(data, spec.category, top_n)))


def violins(df: DataFrame, feature: str = "danceability", top_n: int = 10, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Mean, median and extremes of a feature in the most frequent categories."""
    data = _in_top(df, feature, top_n, spec)
    stats = data.groupBy(spec.category).agg(
        F.count("*").alias("row_count"),
        F.avg(feature).alias("mean"),
        F.min(feature).alias("low"),
        F.max(feature).alias("high"),
    )
    middle = quantiles(data, [feature], (0.5,), [spec.category]).select(
        spec.category, F.col("q")[0].alias("median")
    )
    joined = stats.join(F.broadcast(middle), spec.category)  # top_n rows
    return joined.withColumnRenamed(spec.category, "category").orderBy(F.desc("mean"), "category")


def violin_density(df: DataFrame, feature: str = "danceability", top_n: int = 10, bins: int = 20, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Share of rows per category and bin between the extremes of the category."""
    data = _in_top(df, feature, top_n, spec)
    ends = data.groupBy(spec.category).agg(
        F.min(feature).alias("_lo"), F.max(feature).alias("_hi"), F.count("*").alias("_n")
    )
    v, lo, hi = F.col(feature), F.col("_lo"), F.col("_hi")
    at = F.coalesce(F.floor(ratio((v - lo) * bins, hi - lo)), F.lit(0))
    placed = lookup_join(data, ends, [spec.category], "inner").withColumn(
        "bin", F.least(at, F.lit(bins - 1)).cast("long")
    )
    counts = placed.groupBy(F.col(spec.category).alias("category"), "bin", "_n").agg(
        F.count("*").alias("row_count")
    )
    return counts.withColumn("share", ratio(F.col("row_count"), F.col("_n"))).drop("_n")


def actual_vs_predicted(df: DataFrame, actual: str, models: Sequence[str]) -> DataFrame:
    """Per model: r2 over complete rows and the ends of the diagonal."""
    cols = [actual, *models]
    require_columns(df, cols)
    data = numbers(df.select(*cols), cols).na.drop()
    long = long_rows(data, [(m, F.col(m)) for m in models], ("model", "predicted"), keep=[actual])
    quality = regression_metrics(long, actual, "predicted", ["model"])
    ends = long.groupBy("model").agg(
        F.count("*").alias("row_count"), F.min(actual).alias("low"), F.max(actual).alias("high")
    )
    return quality.join(ends, "model").select("model", "r2", "row_count", "low", "high")


def boxes(df: DataFrame, feature: str = "tempo", top_n: int = 10, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Box-plot numbers of a feature in the most frequent categories."""
    data = _in_top(df, feature, top_n, spec)
    q = quantiles(data, [feature], (0.25, 0.5, 0.75), [spec.category]).select(
        spec.category,
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
    )
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    v = F.col(feature)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    placed = lookup_join(data, q, [spec.category], "inner").withColumn("_in", inside)
    return (
        placed.groupBy(F.col(spec.category).alias("category"), "q1", "median", "q3")
        .agg(
            F.count("*").alias("row_count"),
            F.avg(v).alias("mean"),
            F.min(F.when(F.col("_in"), v)).alias("whisker_low"),
            F.max(F.when(F.col("_in"), v)).alias("whisker_high"),
            F.count_if(~F.col("_in")).alias("outliers"),
        )
        .orderBy(F.desc("mean"), "category")
    )


def score_bars(scores: DataFrame, top_n: int = 20, spec: FeatureSpec = TRACKS) -> DataFrame:
    """The best scores with a readable label, lowest first for a bar chart."""
    require_columns(scores, [spec.name, spec.owner, "preference_score"])
    label = F.concat(
        F.trim(F.coalesce(F.col(spec.name).cast("string"), F.lit(""))),
        F.lit("  —  "),
        F.trim(F.coalesce(F.col(spec.owner).cast("string"), F.lit(""))),
    )
    named = scores.select(label.alias("label"), "preference_score")
    top = named.orderBy(F.desc_nulls_last("preference_score"), "label").limit(top_n)
    return top.orderBy("preference_score", F.desc("label"))
