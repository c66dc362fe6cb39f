"""Data-quality checks. Counts come from one aggregate over the table."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import long_rows, no_nan, safe_corr
from ..spec import TRACKS, FeatureSpec, require_columns
from .clean import duplicate_counts

WEAK_CORRELATION = 0.5  # fixed value: below it the pair counts as weak


def validate_schema(df: DataFrame, spec: FeatureSpec = TRACKS) -> list[str]:
    """Raise on missing columns, warn on extra ones; returns the extra ones."""
    require_columns(df, spec.expected)
    extra = sorted(set(df.columns) - set(spec.expected))
    if extra:
        warnings.warn(f"extra columns: {', '.join(extra)}", stacklevel=2)
    return extra


def range_violations(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Out-of-range values per checked column; NULLs and absent columns pass."""
    bad = {c: ~F.col(c).between(0.0, 1.0) for c in spec.bounded if c in df.columns}
    bad |= {c: F.col(c) <= 0 for c in spec.positive if c in df.columns}
    one = df.agg(*[F.count_if(b).alias(c) for c, b in bad.items()])
    return long_rows(one, [(c, F.col(c)) for c in bad], ("column", "value"))


def validate_ranges(df: DataFrame, spec: FeatureSpec = TRACKS) -> None:
    """Raise one error that names every column with a value out of range."""
    require_columns(df, (*spec.bounded, *spec.positive))
    bad = range_violations(df, spec).filter("value > 0").orderBy("column").collect()
    if bad:
        listed = "; ".join(f"{r['column']} ({r['value']} rows)" for r in bad)
        raise ValueError(f"values out of range: {listed}")


def duplicates(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """One row: surplus exact copies and surplus rows per key (NULL is a key)."""
    counted = duplicate_counts(df, spec.with_roles(order_by=None))
    return counted.select(
        (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"),
        (F.col("rows") - F.col("distinct_keys")).alias("duplicate_keys"),
    )


def inconsistent_keys(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Keys whose rows disagree in a metric that should not vary.

    Two different values exist exactly when min < max, so no distinct count
    (and no second shuffle) is needed.
    """
    spans = [f(c).alias(f"{n}_{c}") for c in spec.consistent for n, f in (("lo", F.min), ("hi", F.max))]
    differ = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(f"lo_{c}") < F.col(f"hi_{c}"), F.lit(False)) for c in spec.consistent],
    )
    keyed = df.na.drop(subset=list(spec.key))
    return keyed.groupBy(*spec.key).agg(*spans).filter(differ).select(*spec.key)


def count_inconsistent(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    return inconsistent_keys(df, spec).agg(F.count("*").alias("inconsistent_keys"))


def pair_correlation(
    df: DataFrame, spec: FeatureSpec = TRACKS, threshold: float = WEAK_CORRELATION
) -> DataFrame:
    """Correlation of two columns that should move together, and whether it is weak."""
    a, b = spec.weak_pair
    x, y = (no_nan(F.col(c).cast("double")) for c in (a, b))
    r = df.agg(safe_corr(x, y).alias("r"))
    return r.select(
        F.lit(a).alias("feature_a"),
        F.lit(b).alias("feature_b"),
        "r",
        F.lit(threshold).alias("threshold"),
        F.coalesce(F.col("r") < threshold, F.lit(False)).alias("is_weak"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """NULL (and NaN) count of every column."""
    one = df.agg(*[_missing(df, c).alias(c) for c in df.columns])
    return long_rows(one, [(c, F.col(f"`{c}`")) for c in df.columns], ("column", "value"))


def _missing(df: DataFrame, c: str):
    col = F.col(f"`{c}`")
    if dict(df.dtypes)[c] in ("double", "float"):
        return F.count_if(col.isNull() | F.isnan(col))
    return F.count_if(col.isNull())


def validation_report(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """All checks as long rows (section, column, value)."""

    def section(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), "column", "value")

    counted = duplicate_counts(df, spec.with_roles(order_by=None))
    has_null = F.max(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in spec.key]).cast("int"))
    null_keys = df.agg(F.coalesce(has_null, F.lit(0)).cast("long").alias("value"))
    totals = long_rows(
        counted,
        [
            ("num_rows", "total", F.col("rows")),
            ("num_columns", "total", F.lit(len(df.columns)).cast("long")),
            ("duplicate_rows", "total", F.col("rows") - F.col("distinct_rows")),
            ("duplicate_keys", "total", F.col("rows") - F.col("distinct_keys")),
            ("unique_keys", "total", F.col("distinct_keys")),
        ],
        ("section", "column", "value"),
    )
    minus = null_keys.select(
        F.lit("unique_keys").alias("section"),
        F.lit("total").alias("column"),
        (-F.col("value")).alias("value"),
    )
    differ = count_inconsistent(df, spec).select(
        F.lit("inconsistent_keys").alias("section"),
        F.lit("total").alias("column"),
        F.col("inconsistent_keys").alias("value"),
    )
    parts = [
        totals,
        minus,
        differ,
        section(missing_summary(df), "missing_values"),
        section(range_violations(df, spec), "range_violations"),
    ]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    # a NULL key is one of the distinct keys but not a unique entity
    return every.groupBy("section", "column").agg(F.sum("value").alias("value"))


def nonzero(report: DataFrame) -> DataFrame:
    """Only the entries of a report that found something."""
    return report.filter("value > 0")
