"""What-if scoring: change features of rows, score them, compare the change."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import half_even, ratio
from ..spec import TRACKS, FeatureSpec

# Default scenarios on the track features.
DEFAULT_SCENARIOS = {
    "increase_danceability": {"danceability": 0.10},
    "increase_energy": {"energy": 0.10},
    "increase_valence": {"valence": 0.10},
    "decrease_acousticness": {"acousticness": -0.10},
    "higher_energy_and_danceability": {"energy": 0.10, "danceability": 0.10},
}

Scorer = Callable[[DataFrame], DataFrame]


def validate_single(rows: DataFrame) -> None:
    n = len(rows.take(2))
    if n == 0:
        raise ValueError("no row to score")
    if n != 1:
        raise ValueError("a single row is needed, but there are more")


def changed(column: str, delta: float, spec: FeatureSpec = TRACKS) -> Column:
    moved = F.col(column) + F.lit(float(delta))
    if column in spec.bounded:
        # greatest and least skip NULL, so a missing value must stay missing
        return F.when(moved.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)))
    return moved


def apply_changes(df: DataFrame, changes: Mapping[str, float], spec: FeatureSpec = TRACKS) -> DataFrame:
    """Add deltas; unit-interval features are clipped, unknown ones ignored."""
    return df.withColumns({c: changed(c, d, spec) for c, d in changes.items() if c in df.columns})


def prediction_change(original: Column, modified: Column) -> dict[str, Column]:
    gap = modified - original
    percent = F.coalesce(ratio(gap, original) * 100, F.lit(0.0))
    return {
        "absolute_change": half_even(gap, 4),
        "percent_change": half_even(F.when(gap.isNotNull(), percent), 4),
    }


def simulate(rows: DataFrame, changes: Mapping[str, float], scorer: Scorer, prediction: str = "prediction", spec=TRACKS) -> DataFrame:
    """Original and modified prediction of each row for one set of changes."""
    return compare_scenarios(rows, {"change": changes}, scorer, (), prediction, spec).drop(
        "scenario", "changes", "rank"
    )


def compare_scenarios(
    rows: DataFrame,
    scenarios: Mapping[str, Mapping[str, float]] | None,
    scorer: Scorer,
    key: Sequence[str],
    prediction: str = "prediction",
    spec: FeatureSpec = TRACKS,
) -> DataFrame:
    """Every row under every scenario, ranked by the signed change within the row.

    Each scenario is scored as one more column of its row, and the ranks come from
    the few changes of that row. So rows are never shuffled, rows that share a key
    are ranked apart, and a key with many rows stays spread over its tasks.
    """
    scenarios = DEFAULT_SCENARIOS if scenarios is None else scenarios
    wide = scorer(rows).select(*rows.columns, F.col(prediction).cast("double").alias("_original"))
    entries = []
    for i, (name, changes) in enumerate(scenarios.items()):
        touched = [c for c in changes if c in rows.columns]
        kept = [F.col(f"`{c}`") for c in wide.columns]
        moved = wide.select(*kept, *[F.col(f"`{c}`").alias(f"_was_{c}") for c in touched])
        moved = moved.withColumns({c: changed(c, changes[c], spec) for c in touched})
        scored = scorer(moved).withColumn(f"_modified_{i}", F.col(prediction).cast("double"))
        back = {c: F.col(f"`_was_{c}`") for c in touched}
        wide = scored.select(*[back.get(c, F.col(f"`{c}`")).alias(c) for c in wide.columns], f"_modified_{i}")
        change = prediction_change(F.col("_original"), F.col(f"_modified_{i}"))
        entries.append(
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(str(dict(changes))).alias("changes"),
                half_even(F.col(f"_modified_{i}"), 4).alias("modified_prediction"),
                *[v.alias(k) for k, v in change.items()],
            )
        )
    names = ["scenario", "changes", "original_prediction", "modified_prediction", "absolute_change", "percent_change"]
    if not entries:
        raise ValueError("at least one scenario is needed")
    listed = wide.select(*key, half_even(F.col("_original"), 4).alias("original_prediction"), F.array(*entries).alias("_all"))
    spread = listed.select("*", F.explode("_all").alias("_one"))
    own = F.col("_one.absolute_change")
    # a missing change ranks after all others
    above = F.filter(F.transform("_all", lambda e: e["absolute_change"]), lambda c: c.isNotNull() & (own.isNull() | (c > own)))
    rank = (F.size(F.array_distinct(above)) + 1).cast("int")
    out = spread.select("*", "_one.*").select(*key, *names, rank.alias("rank"))
    return out
