"""Model quality from tables of actual and predicted values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import half_even, long_rows, ratio, search_tree

METRICS = ("accuracy", "precision", "recall", "f1")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, mae and r2 in one aggregate; r2 is NULL for a constant target."""
    y, e = F.col(actual).cast("double"), F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - ratio(F.sum(e * e), F.count(e) * F.var_pop(y))).alias("r2"),
    )


def _zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def _scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": _zero(tp + tn, tp + fp + fn + tn),
        "precision": _zero(tp, tp + fp),
        "recall": _zero(tp, tp + fn),
        "f1": _zero(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    counted = df.groupBy(*by).agg(
        F.count_if(a & p).alias("tp"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"),
        F.count_if(~a & ~p).alias("tn"),
    )
    out = _scores(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counted.select(*by, *[v.alias(k) for k, v in out.items()])


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """Square matrix over ``labels``; pairs that never occur are 0."""
    names = df.sparkSession.createDataFrame([(v,) for v in labels], df.select(F.col(actual).alias("actual")).schema)
    cells = df.groupBy(F.col(actual).alias("actual")).agg(
        *[F.count_if(F.col(predicted) == v).alias(f"pred_{v}") for v in labels]
    )
    full = names.join(F.broadcast(cells.filter(F.col("actual").isin(list(labels)))), "actual", "left")
    return full.na.fill(0).orderBy("actual")


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, macro and weighted F1 over every label that occurs on either side.

    The rows shrink to one counter per (actual, predicted) pair first.
    """
    cells = confusion_counts(df, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = long_rows(
        cells.withColumn("hit", hit),
        [
            (F.col("actual"), F.col("hit"), F.col("n"), zero),
            (F.col("predicted"), zero, zero, F.col("n")),
        ],
        ("label", "tp", "support", "guessed"),
    )
    each = sides.groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed")
    )
    f1 = _zero(2 * F.col("tp"), F.col("support") + F.col("guessed"))
    return each.withColumn("f1", f1).agg(
        _zero(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        _zero(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def in_top_k(index: Column, scores: Column, k: int) -> Column:
    """Whether the score at ``index`` (0-based) is among the ``k`` largest.

    Equal scores rank by their position.
    """
    own = F.element_at(scores, index.cast("int") + 1)
    ranked = F.transform(scores, lambda s, i: ((s > own) | ((s == own) & (i < index))).cast("int"))
    above = F.aggregate(ranked, F.lit(0), lambda a, b: a + b)
    return above < F.least(F.lit(k), F.size(scores))


def top_k_accuracy(df: DataFrame, index: str, scores: str, k: int = 3) -> DataFrame:
    """Share of rows whose true class is among the ``k`` most probable ones."""
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    return df.agg(
        F.avg(in_top_k(F.col(index), F.col(scores), k).cast("double")).alias("top_k_accuracy")
    )


def with_threshold(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.withColumn("predicted", (F.col(score) >= threshold).cast("int"))


def default_thresholds(start: float = 0.05, stop: float = 0.95, count: int = 91) -> list[float]:
    step = (stop - start) / (count - 1)
    return [start + i * step for i in range(count - 1)] + [stop]


def threshold_curve(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] | None = None
) -> DataFrame:
    """Metrics of ``score >= t`` for every threshold, in one pass.

    Each row only finds the last threshold its score reaches. Counts per such
    slot are added up from the top, so the number of thresholds does not
    multiply the rows.
    """
    ts = sorted(float(t) for t in (thresholds if thresholds is not None else default_thresholds()))
    slot = search_tree(F.col(score).cast("double"), ts, right_closed=False)
    placed = df.select(slot.alias("slot"), (F.col(label) == 1).alias("y")).filter("slot is not null")
    counts = placed.groupBy("slot").agg(
        F.count_if(F.col("y")).alias("p"), F.count_if(~F.col("y")).alias("q")
    )
    every = df.sparkSession.createDataFrame(
        [(-1, None), *enumerate(ts)], "slot int, threshold double"
    )
    # from here on one row per threshold
    filled = every.join(F.broadcast(counts), "slot", "left").na.fill(0, ["p", "q"])
    down = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("slot")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    summed = filled.select(
        "threshold",
        F.sum("p").over(down).alias("tp"),
        F.sum("q").over(down).alias("fp"),
        F.sum("p").over(whole).alias("ps"),
        F.sum("q").over(whole).alias("qs"),
    ).filter("threshold is not null")
    tp, fp = F.col("tp"), F.col("fp")
    out = _scores(tp, fp, F.col("ps") - tp, F.col("qs") - fp)
    return summed.select("threshold", *[v.alias(k) for k, v in out.items()]).orderBy("threshold")


def optimal_threshold(curve: DataFrame, metric: str = "f1") -> DataFrame:
    """The threshold with the best metric; the lowest one on ties."""
    if metric not in METRICS:
        raise ValueError(f"no such metric: '{metric}' (known: {', '.join(sorted(METRICS))})")
    return curve.orderBy(F.desc(metric), "threshold").limit(1)


def compare_results(results: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """Rounded results, best model first."""
    rounded = {c: half_even(F.col(c), 4) for c, t in results.dtypes if t in ("double", "float")}
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return results.withColumns(rounded).orderBy(order, "model")


def prediction_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows, actual and predicted positives and their shares."""
    counted = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(actual) == 1).alias("actual_hits"),
        F.count_if(F.col(predicted) == 1).alias("predicted_hits"),
    )
    return counted.withColumns(
        {
            "actual_rate": ratio(F.col("actual_hits"), F.col("total")),
            "predicted_rate": ratio(F.col("predicted_hits"), F.col("total")),
        }
    )
