"""Similarity recommendations from a liked set, with explanations.

The liked set is a table of keys. Bounds of the catalogue, the profile and the
weights are one row each; they enter the scoring projection as literals, so
scoring is one scan without a join.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import best_row, half_even, long_rows, no_nan, ratio
from ..functions.scale import constants, lookup_join
from ..spec import TRACKS, FeatureSpec, require_columns

METHODS = ("cosine", "euclidean")
WEIGHTS = ("uniform", "inverse_variance")
EPSILON = 1e-9  # fixed value: added to a variance before inverting it


def catalogue(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """The first row per key, with numeric features."""
    require_columns(df, (*spec.features, *spec.key, spec.name, spec.owner))
    rest = sorted(c for c in df.columns if c not in spec.key)
    order = [F.col(spec.order_by)] if spec.order_by else []
    for c in rest:
        order += [F.col(c).isNull(), F.col(c)]
    rows = best_row(df, spec.key, order)
    return rows.withColumns({f: no_nan(F.col(f).cast("double")) for f in spec.features})


def keys_of(rows: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    return rows.select(*spec.key).distinct()


def add_ids(liked: DataFrame | None, items: DataFrame, ids: list, spec: FeatureSpec = TRACKS) -> DataFrame:
    """The liked set with more keys; raises when one is not in the catalogue."""
    new = _key_frame(items, ids, spec)
    unknown = unknown_ids(new, items, spec).distinct().collect()  # no more than the ids passed in
    if unknown:
        shown = [tuple(u) for u in unknown[:5]]
        raise ValueError(f"{len(unknown)} ids are not in the catalogue, e.g. {shown}")
    return new.distinct() if liked is None else liked.unionByName(new).distinct()


def _key_frame(like: DataFrame, ids: list, spec: FeatureSpec) -> DataFrame:
    rows = [i if isinstance(i, tuple) else (i,) for i in ids]
    return like.sparkSession.createDataFrame(rows, like.select(*spec.key).schema)


def find_by_name(items: DataFrame, name: str, owner: str | None = None, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Key of the first item with that name; the owner is a literal substring."""
    hit = F.lower(spec.name) == name.lower()
    if owner:
        hit = hit & F.contains(F.lower(F.col(spec.owner)), F.lit(owner.lower()))
    return items.filter(hit).select(*spec.key).orderBy(*spec.key).limit(1)


def add_by_name(liked, items, name, owner=None, spec: FeatureSpec = TRACKS) -> DataFrame:
    found = find_by_name(items, name, owner, spec).collect()
    if not found:
        by = f" by '{owner}'" if owner else ""
        raise ValueError(f"no item named '{name}'{by} found in the catalogue")
    return add_ids(liked, items, [tuple(found[0])], spec)


def remove_ids(liked: DataFrame, ids: list, spec: FeatureSpec = TRACKS) -> DataFrame:
    return lookup_join(liked, _key_frame(liked, ids, spec), spec.key, "left_anti")


def clear(liked: DataFrame) -> DataFrame:
    return liked.limit(0)


def liked_rows(items: DataFrame, liked: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    return lookup_join(items, liked.select(*spec.key), spec.key, "left_semi")


def show(items: DataFrame, liked: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    return liked_rows(items, liked, spec).select(*spec.key, spec.name, spec.owner, spec.target)


def build_profile(items: DataFrame, liked: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Mean feature vector of the liked rows, one row."""
    rows = liked_rows(items, liked, spec)
    profile = rows.agg(*[F.avg(f).alias(f) for f in spec.features], F.count("*").alias("_n"))
    if profile.first()["_n"] == 0:
        raise ValueError("the liked set is empty; add items first")
    return profile.drop("_n")


@dataclass(frozen=True)
class Taste:
    """Bounds of the catalogue, profile and weights: a few numbers per feature."""

    spec: FeatureSpec
    low: dict
    high: dict
    profile: dict
    weight: dict

    def scaled(self, f: str) -> Column:
        """Min-max scaled feature; a constant feature scales to 0."""
        return self._scale(F.col(f), f)

    def scaled_profile(self, f: str) -> float:
        lo, hi, at = self.low[f], self.high[f], self.profile[f]
        return (at - lo) / (hi - lo) if at is not None and hi > lo else 0.0

    def _scale(self, c: Column, f: str) -> Column:
        lo, hi = self.low[f], self.high[f]
        if lo is None:  # no item has a value: the feature says nothing about any of them
            return F.lit(0.0)
        if not hi > lo:
            return F.when(c.isNotNull(), F.lit(0.0))
        return (c - F.lit(lo)) / F.lit(hi - lo)

    def raw_score(self, method: str) -> Column:
        fs = self.spec.features
        add = lambda cs: reduce(lambda a, b: a + b, cs)
        if method == "euclidean":
            gaps = [self.weight[f] * (self.scaled(f) - self.scaled_profile(f)) ** 2 for f in fs]
            return -add(gaps)
        norm = sum(self.scaled_profile(f) ** 2 for f in fs) ** 0.5
        dot = add([self.scaled(f) * self.scaled_profile(f) for f in fs])
        size = F.sqrt(add([self.scaled(f) * self.scaled(f) for f in fs]))
        zero = F.when(dot.isNotNull(), F.lit(0.0))
        return F.coalesce(ratio(dot, size * norm), zero)

    def top_matches(self, method: str, n: int = 3) -> Column:
        """Names of the ``n`` closest features, comma-joined."""
        pairs = []
        for i, f in enumerate(self.spec.features):
            gap = F.abs(self.scaled(f) - self.scaled_profile(f))
            if method == "euclidean":
                gap = self.weight[f] * gap * gap
            pairs.append(F.struct(gap.alias("d"), F.lit(i).alias("i"), F.lit(f).alias("f")))
        near = F.slice(F.array_sort(F.array(*pairs)), 1, n)
        return F.array_join(F.transform(near, lambda s: s["f"]), ", ")


def learn_taste(items: DataFrame, liked: DataFrame, weights: str = "uniform", spec: FeatureSpec = TRACKS) -> Taste:
    """Bounds of the catalogue and moments of its liked rows, in one pass."""
    if weights not in WEIGHTS:
        raise ValueError(f"weights '{weights}' are none of {', '.join(WEIGHTS)}")
    fs = spec.features
    marks = liked.select(*spec.key).distinct().withColumn("_liked", F.lit(True))
    marked = lookup_join(items.select(*spec.key, *fs), marks, spec.key, "left")
    mine = F.col("_liked")
    got = constants(
        marked,
        n=F.count(mine),
        **{f"lo_{f}": F.min(f) for f in fs},
        **{f"hi_{f}": F.max(f) for f in fs},
        **{f"avg_{f}": F.avg(F.when(mine, F.col(f))) for f in fs},
        **{f"var_{f}": F.var_pop(F.when(mine, F.col(f))) for f in fs},
    )
    if not got["n"]:
        raise ValueError("the liked set is empty; add items first")
    low = {f: got[f"lo_{f}"] for f in fs}
    high = {f: got[f"hi_{f}"] for f in fs}
    weight = {f: 1.0 / len(fs) for f in fs}
    if weights == "inverse_variance":
        if got["n"] < 2:
            warnings.warn(
                "inverse_variance weighting needs at least 2 liked items; using uniform weights",
                stacklevel=3,
            )
        else:
            # variance of the scaled values; a constant feature scales to 0
            known = [f for f in fs if got[f"var_{f}"] is not None]
            spans = {f: high[f] - low[f] or 1.0 for f in known}
            inverse = {f: 1.0 / (got[f"var_{f}"] / spans[f] ** 2 + EPSILON) if f in known else 0.0 for f in fs}
            whole = sum(inverse.values())
            weight = {f: v / whole for f, v in inverse.items()}
    return Taste(spec, low, high, {f: got[f"avg_{f}"] for f in fs}, weight)


def score(items: DataFrame, taste: Taste, method: str = "cosine") -> DataFrame:
    """Raw and normalised score of the whole catalogue."""
    if method not in METHODS:
        raise ValueError(f"method '{method}' is none of {', '.join(METHODS)}")
    raw = items.withColumn("raw_score", taste.raw_score(method))
    ends = constants(raw, lo=F.min("raw_score"), hi=F.max("raw_score"))
    lo, hi = ends["lo"], ends["hi"]
    if lo is None or not hi > lo:
        unit = F.when(F.col("raw_score").isNotNull(), F.lit(0.0))
    else:
        unit = (F.col("raw_score") - F.lit(lo)) / F.lit(hi - lo)
    return raw.withColumn("preference_score", half_even(unit, 4))


def recommend(
    items: DataFrame,
    liked: DataFrame,
    top_n: int | None = None,
    exclude_liked: bool = True,
    method: str = "cosine",
    weights: str = "uniform",
    return_explanations: bool = False,
    deduplicate: bool = True,
    spec: FeatureSpec = TRACKS,
) -> DataFrame:
    """The catalogue by descending similarity to the liked set."""
    if method not in METHODS:
        raise ValueError(f"method '{method}' is none of {', '.join(METHODS)}")
    taste = learn_taste(items, liked, weights, spec)
    shown = [*spec.key, spec.name, spec.owner, spec.category, spec.target, "preference_score"]
    rows = score(items, taste, method)
    if return_explanations:
        rows = rows.withColumn("top_matches", taste.top_matches(method))
        shown.append("top_matches")
    rows = rows.select(*[c for c in shown if c in rows.columns])
    if exclude_liked:
        rows = lookup_join(rows, liked.select(*spec.key), spec.key, "left_anti")
    if deduplicate:
        # the best-scoring row of each (name, owner)
        named = rows.na.drop(subset=[spec.name, spec.owner])
        rank = [-F.col("preference_score"), *[F.col(k) for k in spec.key]]
        rows = best_row(named, [spec.name, spec.owner], rank)
    ranked = rows.orderBy(F.desc_nulls_last("preference_score"), *spec.key)
    return ranked if top_n is None else ranked.limit(top_n)


def explain(
    items: DataFrame,
    liked: DataFrame,
    key: tuple | str | int,
    method: str = "cosine",
    weights: str = "uniform",
    spec: FeatureSpec = TRACKS,
) -> DataFrame:
    """One row per feature: how far the item is from the profile, closest first."""
    taste = learn_taste(items, liked, weights, spec)
    values = key if isinstance(key, tuple) else (key,)
    match = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(spec.key, values)])
    item = items.filter(match).limit(1)
    if item.isEmpty():
        raise ValueError(f"key {values} not found in the catalogue")
    rows = []
    for f in spec.features:
        gap = taste.scaled(f) - taste.scaled_profile(f)
        row = (
            f,
            F.col(f),
            F.lit(taste.profile[f]),
            taste.scaled(f),
            F.lit(taste.scaled_profile(f)),
            gap,
            F.abs(gap),
            F.lit(taste.weight[f]),
        )
        rows.append((*row, -taste.weight[f] * gap**2) if method == "euclidean" else row)
    names = [
        "feature",
        "track_raw",
        "profile_raw",
        "track_scaled",
        "profile_scaled",
        "delta",
        "abs_delta",
        "weight",
    ]
    if method == "euclidean":
        names.append("attribution")
    return long_rows(item, rows, names).orderBy("abs_delta", "feature")


def explain_top(items, liked, key, n: int = 3, method="cosine", weights="uniform", spec: FeatureSpec = TRACKS) -> DataFrame:
    """The ``n`` best and ``n`` worst features, marked in ``bucket``."""
    if n < 1:
        raise ValueError(f"n must be >= 1, got {n}")
    rows = explain(items, liked, key, method, weights, spec)
    best = rows.orderBy("abs_delta", "feature").limit(n).withColumn("bucket", F.lit("matches"))
    worst = (
        rows.orderBy(F.desc("abs_delta"), F.desc("feature"))
        .limit(n)
        .withColumn("bucket", F.lit("mismatches"))
    )
    return best.unionByName(worst)


def seeds(items: DataFrame, n: int = 5, spec: FeatureSpec = TRACKS) -> DataFrame:
    """The ``n`` items with the highest target, a start for a liked set."""
    return items.orderBy(F.desc_nulls_last(spec.target), *spec.key).limit(n)


def known_ids(ids: DataFrame, items: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """The ids the catalogue has.

    The catalogue is filtered by the ids rather than joined to them, so a short
    list of ids never shuffles it.
    """
    keys = ids.select(*spec.key).distinct()
    return lookup_join(items.select(*spec.key), keys, spec.key, "left_semi").distinct()


def unknown_ids(ids: DataFrame, items: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    return lookup_join(ids, known_ids(ids, items, spec), spec.key, "left_anti")
