"""Exact order statistics that never bring a whole column to one task.

``percentile`` keeps every distinct value of a group in one buffer, so it is
used only for groups of a checked size. Larger groups are narrowed down. A sketch
brackets each wanted value; counting gives the exact rank of the bracket, and a
bracket that misses is dropped. While a bracket holds too many rows, a pass
counts them in a fixed number of bins, keeps the bin that holds the wanted rank,
and tightens the bounds to the smallest and largest value seen in it. A pass
shuffles at most bins x groups counters, whatever the number of rows and however
skewed the values.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .expressions import no_nan
from .scale import cut_lineage, local_frame, lookup_join, small_copy, small_table

BINS = 4096
LEAF_ROWS = 100_000  # rows of one interval whose values one task may sort
ACCURACY = 10_000  # of the sketch that gives the first brackets
MARGIN = 2.0 / ACCURACY
DIRECT_VALUES = 1_000_000  # values of one group held by ``percentile`` buffers


def order_statistics(
    values: DataFrame,
    by: Sequence[str],
    ranks: DataFrame,
    bins: int = BINS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The value of each wanted 0-based ``rank`` per group.

    ``values`` has the ``by`` columns and a double ``v`` without NULL or NaN;
    ``ranks`` has ``by``, ``rank``, bounds ``lo`` and ``hi`` of the wanted value
    and ``n`` rows between them; ``below`` counts rows under ``lo`` where that is
    not the minimum. Returns ``by``, ``rank``, ``v``.
    """
    by = list(by)
    interval = [*by, "lo", "hi"]
    below = F.col("below") if "below" in ranks.columns else F.lit(0).cast("long").alias("below")
    state = ranks.select(*by, "rank", "lo", "hi", "n", below)
    done = None
    while True:
        closed, widest, bounds, wanted = _sort_out(state, by)
        done = closed if done is None else done.unionByName(closed)
        if widest is None:
            return _settle(done)
        inside = lookup_join(values, bounds, by, "inner").filter("v between lo and hi")
        if widest <= leaf_rows:
            slot = F.col("v")
        else:
            # halves, because hi - lo may overflow; an infinite bound gives NaN
            span = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
            slot = (
                F.when(F.col("v") == F.col("lo"), F.lit(0.0))
                .when(F.col("v") == F.col("hi"), F.lit(float(bins - 1)))
                .when(F.isnan(span), F.lit(float(bins // 2)))
                .otherwise(F.least(F.floor(span * bins).cast("double"), F.lit(float(bins - 1))))
            )
        counted = inside.groupBy(*interval, "below", slot.alias("slot")).agg(
            F.count("*").alias("m"), F.min("v").alias("from"), F.max("v").alias("to")
        )
        run = Window.partitionBy(*interval).orderBy("slot")
        upto = F.col("below") + F.sum("m").over(run.rowsBetween(Window.unboundedPreceding, 0))
        slots = counted.select(*interval, "m", "from", "to", upto.alias("upto"))
        hit = (F.col("upto") - F.col("m") <= F.col("rank")) & (F.col("rank") < F.col("upto"))
        state = (
            lookup_join(slots, wanted, interval, "inner")
            .filter(hit)
            .select(
                *by,
                "rank",
                F.col("from").alias("lo"),
                F.col("to").alias("hi"),
                F.col("m").alias("n"),
                (F.col("upto") - F.col("m")).alias("below"),
            )
        )


def _settle(state: DataFrame) -> DataFrame:
    """Cut the lineage of the per-group state between two passes."""
    return small_copy(state) or cut_lineage(state)


def _sort_out(state: DataFrame, by: list[str]) -> tuple[DataFrame, int | None, DataFrame, DataFrame]:
    """Solved ranks, rows of the widest open interval, open intervals, open ranks.

    Ranks that share their bounds share one interval. The state of up to a
    bounded number of groups is handled on the driver, so that a pass is one job.
    """
    shared, wanted = [*by, "lo", "hi", "below"], [*by, "lo", "hi", "rank"]
    table = small_table(state)
    if table is not None:
        solved = pc.equal(table["lo"], table["hi"])
        done = table.filter(solved)
        done = done.select([*by, "rank", "lo"]).rename_columns([*by, "rank", "v"])
        left = table.filter(pc.invert(solved))
        like = state.withColumn("v", F.col("lo"))
        bounds = left.group_by(shared).aggregate([]).select(shared)
        return (
            local_frame(done, like),
            pc.max(left["n"]).as_py(),
            local_frame(bounds, like),
            local_frame(left.select(wanted), like),
        )
    state = cut_lineage(state)
    left = state.filter("lo < hi")
    return (
        state.filter("lo = hi").select(*by, "rank", F.col("lo").alias("v")),
        left.agg(F.max("n")).first()[0],
        left.select(*shared).distinct(),
        left.select(*wanted),
    )


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    direct_values: int = DIRECT_VALUES,
    **narrowing,
) -> DataFrame:
    """Linear-interpolated quantiles: ``by``, ``column``, ``q`` (array by prob).

    Columns without a value in a group give no row. ``by`` holds no NULL.
    """
    by, columns = list(by), list(columns)
    names = [f"_v{i}" for i in range(len(columns))]
    data = df.select(*by, *[no_nan(F.col(c).cast("double")).alias(v) for c, v in zip(columns, names)])
    near = F.array(*[F.lit(min(max(p + d, 0.0), 1.0)) for p in probs for d in (-MARGIN, MARGIN)])
    ends = [
        F.struct(
            F.lit(i).alias("c"),
            F.count(v).alias("n"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.percentile_approx(v, near, ACCURACY).alias("near"),
        ).alias(v)
        for i, v in enumerate(names)
    ]
    wide = data.groupBy(*by).agg(*ends)
    each = wide.select(*by, F.explode(F.array(*names)).alias("_e")).select(*by, "_e.*")
    base = _settle(each.filter("n > 0"))
    largest = base.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= direct_values:
        at = F.array(*[F.lit(float(p)) for p in probs])
        found = data.groupBy(*by).agg(*[F.percentile(v, at).alias(v) for v in names])
        out = _long(found, names, by, "q").filter("q is not null")
    else:
        out = _narrowed(data, names, base, probs, by, **narrowing)
    label = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)
    return out.select(*by, label.alias("column"), "q")


def _long(df: DataFrame, names: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """One row per column: its number ``c`` and its value."""
    pairs = [F.struct(F.lit(i).alias("c"), F.col(v).alias(value)) for i, v in enumerate(names)]
    return df.select(*by, F.explode(F.array(*pairs)).alias("_p")).select(*by, "_p.*")


def _narrowed(data: DataFrame, names, base: DataFrame, probs, by, **narrowing) -> DataFrame:
    """Start from approximate brackets; their exact ranks are counted, not trusted."""
    group = [*by, "c"]
    points = [F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]
    want = base.select("*", F.explode(F.array(*points)).alias("_q")).select(
        *group,
        "n",
        "min",
        "max",
        F.col("_q.i").alias("i"),
        ((F.col("n") - 1) * F.col("_q.p")).alias("at"),
        F.element_at("near", 2 * F.col("_q.i") + 1).alias("from"),
        F.element_at("near", 2 * F.col("_q.i") + 2).alias("to"),
    )
    want = want.withColumn("left", F.floor("at").cast("long")).withColumn("right", F.ceil("at").cast("long"))
    want = _settle(want)

    slots = [(c, i) for c in range(len(names)) for i in range(len(probs))]
    ends = []
    for c, i in slots:
        mine = (F.col("c") == c) & (F.col("i") == i)
        ends += [F.max(F.when(mine, F.col(e))).alias(f"_{e}_{c}_{i}") for e in ("from", "to")]
    brackets = want.groupBy(*by).agg(*ends)
    if by:
        rows = lookup_join(data, brackets, by, "inner")
    else:
        rows = data.withColumns({k: F.lit(v) for k, v in brackets.first().asDict().items()})
    counts, near = [], F.lit(False)
    for c, i in slots:
        v, lo, hi = F.col(names[c]), F.col(f"_from_{c}_{i}"), F.col(f"_to_{c}_{i}")
        near = near | F.coalesce(v.between(lo, hi), F.lit(False))
        counts.append(
            F.struct(
                F.lit(c).alias("c"),
                F.lit(i).alias("i"),
                F.count_if(v < lo).alias("below"),
                F.count_if(v.between(lo, hi)).alias("inside"),
            ).alias(f"_k_{c}_{i}")
        )
    counted = rows.groupBy(*by).agg(*counts)
    each = F.explode(F.array(*[F.col(f"_k_{c}_{i}") for c, i in slots])).alias("_k")
    counted = counted.select(*by, each).select(*by, "_k.*")
    placed = _settle(want.join(counted, [*group, "i"]))

    rank = F.explode(F.array("left", "right")).alias("rank")
    ranks = placed.select(*group, "n", "min", "max", "from", "to", "below", "inside", rank)
    caught = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside"))
    ranks = ranks.withColumn("_ok", caught).select(
        *group,
        "rank",
        "_ok",
        F.when(F.col("_ok"), F.col("from")).otherwise(F.col("min")).alias("lo"),
        F.when(F.col("_ok"), F.col("to")).otherwise(F.col("max")).alias("hi"),
        F.when(F.col("_ok"), F.col("inside")).otherwise(F.col("n")).alias("n"),
        F.when(F.col("_ok"), F.col("below")).otherwise(F.lit(0)).alias("below"),
    )
    # one search per rank, whichever bracket it came from
    ranks = ranks.groupBy(*group, "rank").agg(
        F.min(F.struct("n", "lo", "hi", "below", "_ok")).alias("_s")
    )
    ranks = _settle(ranks.select(*group, "rank", "_s.*"))
    missed = ranks.filter("not _ok").limit(1).count()
    kept = rows if missed else rows.filter(near)
    values = _long(kept.select(*by, *names), names, by, "v").filter("v is not null")
    found = order_statistics(values, group, ranks, **narrowing)
    left = found.select(*group, F.col("rank").alias("left"), F.col("v").alias("lv"))
    right = found.select(*group, F.col("rank").alias("right"), F.col("v").alias("rv"))
    value = F.when(F.col("left") == F.col("right"), F.col("lv")).otherwise(
        (F.col("right") - F.col("at")) * F.col("lv") + (F.col("at") - F.col("left")) * F.col("rv")
    )
    solved = want.join(left, [*group, "left"]).join(right, [*group, "right"])
    listed = F.array_sort(F.collect_list(F.struct("i", value.alias("v"))))
    return solved.groupBy(*group).agg(listed["v"].alias("q"))
