"""Checked queries: the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chartdata, models, recommend, split
from .bindings import EVENTS, ITEMS, ITEMS_SQL, PARTS, PARTS_SQL
from .checks_analysis import score_sql
from .checks_models import _stages, hash_sql
from .checks_tables import correlation_cells
from .registry import outer, query


@query(
    "viz1_top_categories",
    """SELECT p_brand AS category, count(*) AS row_count FROM part GROUP BY p_brand
ORDER BY row_count DESC, category LIMIT 10""",
)
def _top(t):
    return chartdata.top_categories(t.part, 10, PARTS.with_roles(category="p_brand"))


@query(
    "viz2_histogram",
    outer(
        "",
        "bin row_count",
        "bin_low bin_high",
        """SELECT bin, bin_low, bin_high, count(value) AS row_count FROM (
          SELECT i AS bin, lo + i * step AS bin_low, CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * step END AS bin_high
          FROM (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 20 AS step FROM events),
            (SELECT unnest(range(20)) AS i)) b
        LEFT JOIN events ON value >= bin_low AND (value < bin_high OR (bin = 19 AND value = bin_high))
        GROUP BY bin, bin_low, bin_high""",
    ),
)
def _histogram(t):
    return chartdata.histogram(t.events, "value", 20, EVENTS)


@query(
    "viz3_correlation_bars",
    outer(
        PARTS_SQL,
        "feature negative",
        "r",
        "\nUNION ALL ".join(
            f"SELECT '{f}' AS feature, corr({f}, demand) AS r, corr({f}, demand) < 0 AS negative FROM catalogue"
            for f in PARTS.features
        ),
    ),
)
def _bars(t):
    return chartdata.correlation_bars(t.catalogue, PARTS)


@query("viz4_correlation_forest")
def _forest(t):
    return chartdata.correlation_forest(t.items, n_bootstrap=1000, spec=ITEMS)


@query(
    "viz5_category_targets",
    outer(
        PARTS_SQL,
        "category row_count",
        "mean_target std_target",
        """SELECT p_brand AS category, count(*) AS row_count, avg(demand) AS mean_target,
        stddev_samp(demand) AS std_target FROM catalogue GROUP BY p_brand ORDER BY row_count DESC, category LIMIT 15""",
    ),
)
def _targets(t):
    return chartdata.category_targets(t.catalogue, 15, PARTS.with_roles(category="p_brand"))


@query(
    "viz6_heatmap",
    outer(PARTS_SQL, "feature_a feature_b", "r", correlation_cells("catalogue", list(PARTS.features))),
)
def _heatmap(t):
    return chartdata.heatmap(t.catalogue, PARTS)


@query(
    "viz7_hit_profiles_scaled",
    outer(
        ITEMS_SQL,
        "feature",
        "hit_mean non_hit_mean",
        "\nUNION ALL ".join(
            f"""SELECT '{f}' AS feature, avg(s) FILTER (WHERE l_extendedprice >= 70000) AS hit_mean,
            avg(s) FILTER (WHERE l_extendedprice < 70000) AS non_hit_mean FROM (
              SELECT l_extendedprice, ({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER ()) AS s FROM items)"""
            for f in ITEMS.features
        ),
    ),
)
def _profiles(t):
    return chartdata.hit_profiles_scaled(t.items, 70000, ITEMS)


@query(
    "viz8_scatter_sample",
    outer(
        PARTS_SQL,
        "p_partkey",
        "avg_quantity avg_tax demand",
        f"""SELECT p_partkey, avg_quantity, avg_tax, demand FROM catalogue
        ORDER BY {hash_sql("p_partkey")}, p_partkey LIMIT 500""",
    ),
)
def _scatter(t):
    return chartdata.scatter(t.catalogue, "avg_quantity", "avg_tax", 500, spec=PARTS)


@query(
    "viz9_largest_values",
    outer(
        "",
        "feature",
        "importance",
        "SELECT p_name AS feature, sum(p_retailprice) AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
)
def _importance(t):
    table = t.part.groupBy(F.col("p_name").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return chartdata.importance_bars(table, 10)


@query(
    "viz10_violins",
    outer(
        PARTS_SQL,
        "category row_count",
        "mean low high median",
        """SELECT p_brand AS category, count(*) AS row_count, avg(avg_quantity) AS mean, min(avg_quantity) AS low,
        max(avg_quantity) AS high, quantile_cont(avg_quantity, 0.5) AS median FROM catalogue GROUP BY p_brand
        ORDER BY row_count DESC, category LIMIT 10""",
    ),
)
def _violins(t):
    return chartdata.violins(t.catalogue, "avg_quantity", 10, PARTS.with_roles(category="p_brand"))


@query(
    "viz10_violin_density",
    outer(
        "",
        "category bin row_count",
        "share",
        """SELECT event_type AS category, CAST(least(floor((value - lo) * 20 / (hi - lo)), 19) AS BIGINT) AS bin,
        count(*) AS row_count, count(*) / any_value(n)::DOUBLE AS share FROM (
          SELECT event_type, value, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n
          FROM events WINDOW w AS (PARTITION BY event_type)) GROUP BY 1, 2""",
    ),
)
def _density(t):
    return chartdata.violin_density(t.events, "value", 10, 20, EVENTS)


@query(
    "viz11_actual_vs_predicted",
    outer(
        """guesses AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS a, l_quantity * 1000 + l_discount * 10000 AS b
  FROM lineitem)""",
        "model row_count",
        "r2 low high",
        "\nUNION ALL ".join(
            f"""SELECT '{m}' AS model, count(*) AS row_count, min(y) AS low, max(y) AS high,
            1 - sum((y - {c}) * (y - {c})) / (count(*) * var_pop(y)) AS r2 FROM guesses"""
            for m, c in (("by_quantity", "a"), ("by_discount", "b"))
        ),
    ),
)
def _actual(t):
    rows = t.lineitem.select(
        "l_extendedprice",
        (F.col("l_quantity") * 1500).alias("by_quantity"),
        (F.col("l_quantity") * 1000 + F.col("l_discount") * 10000).alias("by_discount"),
    )
    return chartdata.actual_vs_predicted(rows, "l_extendedprice", ["by_quantity", "by_discount"])


@query("viz11_model_fit_quality")
def _fit_quality(t):
    train, test = split.train_test(split.hash_split(t.catalogue, PARTS.key))
    stages = _stages(t, train)
    linear = models.fit_linear(train, "demand", stages, "linear")
    rows = linear.transform(test).select("demand", "linear", F.lit(50.0).alias("constant"))
    return chartdata.actual_vs_predicted(rows, "demand", ["linear", "constant"])


@query(
    "viz12_boxes",
    outer(
        """q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)""",
        "category row_count outliers",
        "q1 median q3 mean whisker_low whisker_high",
        """SELECT event_type AS category, q1, median, q3, count(*) AS row_count, avg(value) AS mean,
        min(value) FILTER (WHERE inside) AS whisker_low, max(value) FILTER (WHERE inside) AS whisker_high,
        CAST(count_if(NOT inside) AS BIGINT) AS outliers FROM (
          SELECT *, value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside
          FROM events JOIN q USING (event_type)) GROUP BY 1, 2, 3, 4""",
    ),
)
def _boxes(t):
    return chartdata.boxes(t.events, "value", 10, EVENTS)


@query(
    "viz13_score_bars",
    outer(
        f"{score_sql('cosine', 'uniform')}",
        "label",
        "preference_score",
        """SELECT trim(p_name) || '  —  ' || trim(p_brand) AS label, preference_score FROM scores
        ORDER BY preference_score DESC, label LIMIT 20""",
    ),
)
def _scores(t):
    taste = recommend.learn_taste(t.catalogue, t.liked, spec=PARTS)
    return chartdata.score_bars(recommend.score(t.catalogue, taste), 20, PARTS)

