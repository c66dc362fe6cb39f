"""Inference helpers: p-values, Holm adjustment, bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .expressions import key_hash, long_rows, ratio
from .scale import constants

BLOCKS = 4096


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float, n: float) -> float:
    """Two-sided p-value of Pearson r over n pairs (t with n - 2 degrees)."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return math.nan
    r = min(max(r, -1.0), 1.0)
    if abs(r) == 1.0:
        return 0.0
    if n > 1e7:  # t and normal agree, and lgamma would cancel
        return math.erfc(abs(r) * math.sqrt((n - 2) / (1 - r * r)) / math.sqrt(2.0))
    return _incomplete_beta((n - 2) / 2.0, 0.5, 1.0 - r * r)


@F.pandas_udf(DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """:func:`correlation_p` for the few rows of a correlation table."""
    return pd.Series([correlation_p(a, b) for a, b in zip(r, n)], dtype="float64")


def holm_adjust(df: DataFrame, p: str = "p_value", family: Sequence[str] = (), out: str = "p_value_adjusted") -> DataFrame:
    """Holm step-down adjustment; missing p-values stay missing and uncounted.

    A family is a set of hypotheses, a handful of rows, so it is one window.
    """
    col = F.nanvl(F.col(p), F.lit(None).cast("double"))
    whole = Window.partitionBy(*family, col.isNull())
    step = whole.orderBy(col.asc_nulls_last())
    left = F.count(col).over(whole) - F.row_number().over(step) + 1
    upto = step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raised = df.withColumn("_raw", F.when(col.isNotNull(), col * left))
    adjusted = F.when(col.isNotNull(), F.least(F.lit(1.0), F.max("_raw").over(upto)))
    return raised.withColumn(out, adjusted).drop("_raw")


def poisson_cuts(most: int = 9) -> list[float]:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable with mean 1."""
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


def bootstrap_intervals(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: Sequence[str],
    n_bootstrap: int = 1000,
    alpha: float = 0.05,
    seed: int | None = 42,
    blocks: int = BLOCKS,
) -> DataFrame:
    """Percentile-bootstrap interval of r(feature, target) per feature.

    One rule at every size: rows fall into ``blocks`` groups by the hash of their key, and each
    draw gives each group a Poisson weight that follows from seed, draw and group. One
    pass over the data reduces every group to its moments; all draws then work on those
    few rows. Groups of independent rows vary like the rows themselves, and a table with
    far fewer rows than blocks has one row per group. Rows that share a key are drawn together.
    """
    schema = "feature string, ci_low double, ci_high double"
    if n_bootstrap <= 0:
        return df.sparkSession.createDataFrame([(f, None, None) for f in features], schema)
    entropy = int(np.random.SeedSequence().entropy % (2**32)) if seed is None else int(seed)
    y = F.col(target)
    pairs = {f: F.col(f).isNotNull() & y.isNotNull() for f in features}
    middle = constants(
        df,
        **{f"x{i}": F.avg(F.when(both, F.col(f))) for i, (f, both) in enumerate(pairs.items())},
        **{f"y{i}": F.avg(F.when(both, y)) for i, both in enumerate(pairs.values())},
    )

    def sums(i: int, f: str) -> list[Column]:
        """Count and moments about the middle of all rows, so that no large numbers cancel."""
        x = F.when(pairs[f], F.col(f) - F.lit(middle[f"x{i}"]))
        d = F.when(pairs[f], y - F.lit(middle[f"y{i}"]))
        whole = [F.count(x).cast("double"), *[F.sum(v) for v in (x, d, x * x, d * d, x * d)]]
        return [F.coalesce(v, F.lit(0.0)).alias(f"m{i}_{j}") for j, v in enumerate(whole)]

    moments = [c for i, f in enumerate(features) for c in sums(i, f)]
    grouped = df.groupBy((key_hash(f"block:{entropy}", key) % blocks).alias("block")).agg(*moments)
    # The groups are few rows that become many: spread them first.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = grouped.repartition(tasks).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))).alias("draw"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"draw:{entropy}"), "draw", "block")), 1, 8), 16, 10).cast("double") / 2.0**32
    draws = draws.withColumn("u", F.explode(F.array(u)))  # Catalyst repeats no generator, so the digest is taken once
    weight = F.lit(0)
    for cut in poisson_cuts():
        weight = weight + (F.col("u") >= cut).cast("int")
    weighed = draws.withColumn("w", weight)
    names = [f"m{i}_{j}" for i in range(len(features)) for j in range(6)]
    each = weighed.groupBy("draw").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])

    def correlation(i: int) -> Column:
        n, sx, sy, sxx, syy, sxy = (F.col(f"m{i}_{j}") for j in range(6))
        cxx, cyy = sxx - ratio(sx * sx, n), syy - ratio(sy * sy, n)
        varies = (cxx > 1e-12 * sxx) & (cyy > 1e-12 * syy)
        return F.when(varies, (sxy - ratio(sx * sy, n)) / F.sqrt(cxx * cyy))

    ends = [F.percentile(correlation(i), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias(f"q{i}") for i in range(len(features))]
    rows = [(f, F.col(f"q{i}")[0], F.col(f"q{i}")[1]) for i, f in enumerate(features)]
    return long_rows(each.agg(*ends), rows, ("feature", "ci_low", "ci_high"))
