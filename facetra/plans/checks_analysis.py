"""Checked queries: category analysis, correlations and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.stats import holm_adjust
from ..operators import analyze, recommend
from ..sources import tables as io
from .bindings import EVENTS, ITEMS, ITEMS_SQL, LIKED_SQL, PARTS, PARTS_SQL, scratch
from .registry import outer, query

# category analysis -----------------------------------------------------------

FEATURES = ITEMS.features
STATS_SQL = (
    ITEMS_SQL
    + ",\nstats AS (SELECT line_group, "
    + ", ".join(f"avg({f}) AS {f}_group_mean, stddev_samp({f}) AS {f}_group_std" for f in FEATURES)
    + " FROM items GROUP BY line_group)"
)
GROUP_COLUMNS = [f"{f}_group_{s}" for f in FEATURES for s in ("mean", "std")]
Z_SQL = (
    STATS_SQL
    + ",\nz AS (SELECT *, "
    + ", ".join(f"({f} - {f}_group_mean) / nullif({f}_group_std, 0) AS z{i}" for i, f in enumerate(FEATURES))
    + " FROM items JOIN stats USING (line_group)),\nscored AS (SELECT *, round_even((abs(z0) + abs(z1) + abs(z2)) / 3, 4)"
    + " AS deviation_score, "
    + ", ".join(f"round_even(z{i}, 4) AS {f}_zscore" for i, f in enumerate(FEATURES))
    + " FROM z)"
)
ITEM_KEEP = "l_orderkey l_linenumber line_group"


@query(
    "ana1_enrich_with_group_stats",
    outer(
        STATS_SQL,
        ITEM_KEEP,
        "l_quantity l_extendedprice l_discount l_tax " + " ".join(GROUP_COLUMNS),
        "SELECT * FROM items LEFT JOIN stats USING (line_group)",
    ),
)
def _enrich(t):
    return analyze.enrich(t.items, ITEMS)


@query(
    "ana2_group_deviations",
    outer(
        Z_SQL,
        ITEM_KEEP,
        "l_extendedprice deviation_score " + " ".join(f"{f}_zscore" for f in FEATURES),
        "SELECT * FROM scored",
    ),
)
def _deviations(t):
    rows = analyze.deviations(t.items, ITEMS)
    zs = [f"{f}_zscore" for f in FEATURES]
    return rows.select(*ITEM_KEEP.split(), "l_extendedprice", "deviation_score", *zs)


@query(
    "ana3_group_outliers",
    outer(
        Z_SQL,
        ITEM_KEEP,
        "l_extendedprice deviation_score",
        """SELECT * FROM scored WHERE deviation_score > 1.5
        ORDER BY deviation_score DESC, l_orderkey, l_linenumber LIMIT 20""",
    ),
)
def _outliers(t):
    return analyze.outliers(t.items, 1.5, 20, ITEMS)


@query(
    "ana3_outlier_total",
    outer(
        Z_SQL,
        "outliers",
        "max_score",
        "SELECT count(*) AS outliers, max(deviation_score) AS max_score FROM scored WHERE deviation_score > 1.5",
    ),
)
def _total(t):
    return analyze.outlier_total(t.items, 1.5, ITEMS)


@query(
    "ana3_event_outliers",
    outer(
        "",
        "event_id event_type user_id",
        "deviation_score",
        """SELECT * FROM (SELECT event_id, event_type, user_id,
          round_even(abs(value - avg(value) OVER w) / stddev_samp(value) OVER w, 4) AS deviation_score
          FROM events WINDOW w AS (PARTITION BY event_type)) WHERE deviation_score > 2
        ORDER BY deviation_score DESC, event_id LIMIT 20""",
    ),
)
def _event_outliers(t):
    return analyze.outliers(t.events, spec=EVENTS)


def correlation_rows(table: str, features, target: str) -> str:
    each = []
    for f in features:
        r = f"corr({f}, {target})"
        label = f"""CASE WHEN abs({r}) >= 0.7 THEN 'strong' WHEN abs({r}) >= 0.4 THEN 'moderate'
          WHEN abs({r}) >= 0.2 THEN 'weak' ELSE 'very weak' END"""
        each.append(
            f"""SELECT '{f}' AS feature, round_even({r}, 4) AS correlation, round_even(abs({r}), 4) AS abs_correlation,
            CASE WHEN {r} > 0 THEN 'positive' ELSE 'negative' END AS direction, {label} AS strength,
            count(*) AS n FROM {table} WHERE {f} IS NOT NULL AND {target} IS NOT NULL"""
        )
    return "\nUNION ALL ".join(each)


CORRELATION_SQL = outer(
    PARTS_SQL,
    "feature direction strength n",
    "correlation abs_correlation",
    correlation_rows("catalogue", PARTS.features, "demand"),
)


@query("ana4_target_correlations", CORRELATION_SQL)
def _correlations(t):
    return analyze.describe_correlations(analyze.correlations(t.catalogue, PARTS))


@query(
    "ana4_item_correlations",
    outer(
        ITEMS_SQL,
        "feature direction strength n",
        "correlation abs_correlation",
        correlation_rows("items", FEATURES, "l_extendedprice"),
    ),
)
def _item_correlations(t):
    return analyze.describe_correlations(analyze.correlations(t.items, ITEMS))


WEIGHT_SQL = " + ".join(f"CAST(u >= CAST({c!r} AS DOUBLE) AS INTEGER)" for c in stats.poisson_cuts())
BLOCK_SQL = "CAST('0x' || substr(md5('block:42|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) % 4096"
INTERVALS_SQL = f"""{ITEMS_SQL},
middle AS (SELECT {", ".join(f"avg({f}) AS m_{f}" for f in FEATURES)}, avg(l_extendedprice) AS m_y FROM items),
moved AS (SELECT {BLOCK_SQL} AS block, {", ".join(f"{f} - m_{f} AS {f}" for f in FEATURES)}, l_extendedprice - m_y AS y FROM items, middle),
sums AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, block, count(*) AS n, sum({f}) AS sx, sum(y) AS sy, sum({f} * {f}) AS sxx, sum(y * y) AS syy, sum({f} * y) AS sxy FROM moved GROUP BY block" for f in FEATURES)}),
draws AS (SELECT draw, block, CAST('0x' || substr(md5('draw:42|' || CAST(draw AS VARCHAR) || '|' || CAST(block AS VARCHAR)), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
  FROM (SELECT DISTINCT block FROM sums), (SELECT unnest(range(1000)) AS draw)),
weights AS (SELECT draw, block, {WEIGHT_SQL} AS w FROM draws),
each AS (SELECT feature, draw, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * syy) AS syy, sum(w * sxy) AS sxy
  FROM sums JOIN weights USING (block) WHERE w > 0 GROUP BY feature, draw),
r AS (SELECT feature, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r FROM each)"""


@query(
    "ana5_intervals",
    outer(
        INTERVALS_SQL,
        "feature",
        "ci_low ci_high",
        """SELECT feature, quantile_cont(r, CAST(0.025 AS DOUBLE)) AS ci_low, quantile_cont(r, CAST(0.975 AS DOUBLE)) AS ci_high
        FROM r GROUP BY feature""",
    ),
)
def _intervals(t):
    return stats.bootstrap_intervals(t.items, FEATURES, "l_extendedprice", ITEMS.key)


@query("ana5_correlation_inference")
def _inference(t):
    return analyze.infer_correlations(t.items, spec=ITEMS)


HOLM_SQL = """tests AS (
  SELECT p_brand, CASE WHEN sum(p_size) % 7 <> 0 THEN (sum(p_size) % 97) / 1000::DOUBLE END AS p_value
  FROM part GROUP BY p_brand)"""


@query(
    "ana6_holm_adjustment",
    outer(
        HOLM_SQL,
        "p_brand",
        "p_value p_value_adjusted",
        """SELECT p_brand, p_value, CASE WHEN p_value IS NOT NULL THEN least(1, max(p_value * (m - i + 1)) OVER (
          ORDER BY i)) END AS p_value_adjusted FROM (
          SELECT *, count(p_value) OVER () AS m, row_number() OVER (ORDER BY p_value NULLS LAST, p_brand) AS i
          FROM tests)""",
    ),
)
def _holm(t):
    total = F.sum("p_size")
    tests = t.part.groupBy("p_brand").agg(F.when(total % 7 != 0, (total % 97) / 1000.0).alias("p_value"))
    return holm_adjust(tests)


COMPARE_SQL = """compared AS (SELECT p_type AS category, count(*) AS row_count,
  round_even(avg(demand), 1) AS avg_target, """ + ", ".join(
    f"round_even(avg({f}), 4) AS avg_{f}" for f in PARTS.features
) + " FROM catalogue GROUP BY p_type ORDER BY row_count DESC, category LIMIT 10)"
COMPARED = "avg_target " + " ".join(f"avg_{f}" for f in PARTS.features)


@query(
    "ana7_compare_categories",
    outer(f"{PARTS_SQL},\n{COMPARE_SQL}", "category row_count", COMPARED, "SELECT * FROM compared"),
)
def _compare(t):
    return analyze.compare_categories(t.catalogue, spec=PARTS)


def bucket_sql(table: str, feature: str, target: str, n: int) -> str:
    return f"""SELECT i AS bucket_id, printf('%.2f-%.2f', lo + i * step, CASE WHEN i = {n - 1} THEN hi ELSE lo + (i + 1) * step END) AS bucket,
      round_even(avg({target}), 2) AS avg_target, count({target}) AS row_count
    FROM (SELECT min({feature}) AS lo, max({feature}) AS hi, (max({feature}) - min({feature})) / {n} AS step FROM {table}) e
    CROSS JOIN (SELECT unnest(range({n})) AS i) b
    LEFT JOIN {table} ON ({feature} > lo + i * step OR (i = 0 AND {feature} = lo))
      AND {feature} <= CASE WHEN i = {n - 1} THEN hi ELSE lo + (i + 1) * step END
    GROUP BY i, lo, hi, step"""


@query(
    "ana8_feature_buckets",
    outer(ITEMS_SQL, "bucket_id bucket row_count", "avg_target", bucket_sql("items", "l_quantity", "l_extendedprice", 5)),
)
def _buckets(t):
    return analyze.feature_buckets(t.items, "l_quantity", 5, ITEMS)


@query(
    "ana8_feature_buckets_sparse",
    outer(
        "",
        "bucket_id bucket row_count",
        "avg_target",
        bucket_sql("events", "value", "user_id", 40),
    ),
)
def _buckets_sparse(t):
    return analyze.feature_buckets(t.events, "value", 40, EVENTS)


@query("ana9_analysis_tables")
def _analysis(t):
    out = analyze.run_analysis(t.catalogue, PARTS, n_bootstrap=1000)
    tables = {k: v for k, v in out.items() if k != "feature_buckets"} | out["feature_buckets"]
    parts = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(k)) for k, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


CONTRAST = "\nUNION ALL ".join(
    f"""SELECT '{m}' AS metric, arg_min(category, ({{}}, category)) AS most, max({m}) AS most_value,
    arg_min(category, ({m}, category)) AS least, min({m}) AS least_value FROM compared""".format(f"-{m}")
    for m in COMPARED.split()
)


@query(
    "ana10_category_contrasts",
    outer(f"{PARTS_SQL},\n{COMPARE_SQL}", "metric most least", "most_value least_value", CONTRAST),
)
def _contrasts(t):
    return analyze.contrasts(analyze.compare_categories(t.catalogue, spec=PARTS))


@query(
    "ana11_directions",
    f"""WITH found AS ({CORRELATION_SQL})
SELECT direction, string_agg(feature, ', ' ORDER BY feature) AS features,
  CAST(count_if(abs_correlation >= 0.05) AS BIGINT) AS significant, count(*) AS total FROM found GROUP BY direction""",
)
def _directions(t):
    found = analyze.describe_correlations(analyze.correlations(t.catalogue, PARTS))
    return analyze.directions(found.withColumn("significant", F.col("abs_correlation") >= 0.05))


@query(
    "ana12_category_extremes",
    outer(
        PARTS_SQL,
        "category row_count side",
        "avg_target",
        """SELECT category, row_count, side, avg_target FROM (
          SELECT p_brand AS category, avg(demand) AS avg_target, count(*) AS row_count,
            row_number() OVER (ORDER BY avg(demand) DESC, p_brand) AS a,
            row_number() OVER (ORDER BY avg(demand), p_brand) AS b FROM catalogue GROUP BY p_brand) r
        JOIN (SELECT unnest(['top', 'bottom']) AS side) ON (side = 'top' AND a <= 5) OR (side = 'bottom' AND b <= 5)""",
    ),
)
def _extremes(t):
    return analyze.category_extremes(t.catalogue, 5, PARTS.with_roles(category="p_brand"))


@query(
    "ana12_flag_means",
    outer(
        PARTS_SQL,
        "is_large row_count",
        "avg_target",
        "SELECT is_large, avg(demand) AS avg_target, count(*) AS row_count FROM catalogue GROUP BY is_large",
    ),
)
def _flag(t):
    return analyze.flag_means(t.catalogue, PARTS)


# recommendation ----------------------------------------------------------------

FS = PARTS.features
SCALED_SQL = f"""{PARTS_SQL},
{LIKED_SQL},
ends AS (SELECT {", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in FS)} FROM catalogue),
scaled AS (SELECT catalogue.*, {", ".join(f"coalesce(({f} - lo_{f}) / nullif(hi_{f} - lo_{f}, 0), 0) AS s_{f}" for f in FS)}
  FROM catalogue, ends),
mine AS (SELECT {", ".join(f"avg({f}) AS m_{f}, avg(s_{f}) AS p_{f}, var_pop(s_{f}) AS v_{f}" for f in FS)}
  FROM scaled WHERE p_partkey IN (SELECT p_partkey FROM liked))"""


def weights_sql(kind: str) -> str:
    if kind == "uniform":
        return "weights AS (SELECT " + ", ".join(f"1 / {len(FS)}::DOUBLE AS w_{f}" for f in FS) + ")"
    inverse = {f: f"1 / (v_{f} + 1e-9)" for f in FS}
    total = " + ".join(inverse.values())
    return "weights AS (SELECT " + ", ".join(f"({v}) / ({total}) AS w_{f}" for f, v in inverse.items()) + " FROM mine)"


def score_sql(method: str, kind: str) -> str:
    if method == "cosine":
        dot = " + ".join(f"s_{f} * p_{f}" for f in FS)
        a = " + ".join(f"s_{f} * s_{f}" for f in FS)
        b = " + ".join(f"p_{f} * p_{f}" for f in FS)
        raw = f"coalesce(({dot}) / nullif(sqrt({a}) * sqrt({b}), 0), 0)"
        gap = {f: f"abs(s_{f} - p_{f})" for f in FS}
    else:
        gap = {f: f"w_{f} * (s_{f} - p_{f}) * (s_{f} - p_{f})" for f in FS}
        raw = "-(" + " + ".join(gap.values()) + ")"
    pairs = ", ".join(f"{{'d': {g}, 'i': {i}, 'f': '{f}'}}" for i, (f, g) in enumerate(gap.items()))
    return f"""{SCALED_SQL},
{weights_sql(kind)},
raws AS (SELECT scaled.*, {raw} AS raw_score,
  array_to_string([x.f FOR x IN list_sort([{pairs}])[1:3]], ', ') AS top_matches
  FROM scaled, mine, weights),
scores AS (SELECT *, round_even(coalesce((raw_score - min(raw_score) OVER ()) /
  nullif(max(raw_score) OVER () - min(raw_score) OVER (), 0), 0), 4) AS preference_score FROM raws)"""


BEST_SQL = """SELECT * FROM scores WHERE p_partkey NOT IN (SELECT p_partkey FROM liked)
  QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY preference_score DESC, p_partkey) = 1"""
SHOWN = "p_partkey p_name p_brand p_type"


@query(
    "prf1_catalogue",
    outer(
        "",
        "l_partkey l_suppkey l_orderkey",
        "l_quantity",
        """SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_quantity, l_suppkey) = 1""",
    ),
)
def _catalogue(t):
    spec = PARTS.with_roles(key=("l_partkey",), features=("l_quantity",), name="l_orderkey", owner="l_suppkey")
    return recommend.catalogue(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity"), spec)


@query(
    "prf2_add_by_id",
    f"""WITH {LIKED_SQL} SELECT p_partkey FROM liked
UNION SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3)""",
)
def _add(t):
    top = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(3).select("p_partkey").collect()
    return recommend.add_ids(t.liked, t.part, [r[0] for r in top], PARTS)


@query(
    "prf3_find_by_name",
    """SELECT min(p_partkey) AS p_partkey FROM part WHERE lower(p_name) = 'small ring' AND contains(lower(p_brand), '#1')""",
)
def _find(t):
    return recommend.find_by_name(t.part, "Small RING", "#1", PARTS)


@query(
    "prf4_remove",
    f"""WITH {LIKED_SQL} SELECT p_partkey FROM liked WHERE p_partkey NOT IN (SELECT min(p_partkey) FROM liked)""",
)
def _remove(t):
    first = t.liked.agg(F.min("p_partkey")).first()[0]
    return recommend.remove_ids(t.liked, [first], PARTS)


@query(
    "prf5_show_liked",
    outer(
        f"{PARTS_SQL},\n{LIKED_SQL}",
        "p_partkey p_name p_brand",
        "demand",
        "SELECT * FROM catalogue WHERE p_partkey IN (SELECT p_partkey FROM liked)",
    ),
)
def _show(t):
    return recommend.show(t.catalogue, t.liked, PARTS)


@query(
    "prf6_profile",
    outer(
        SCALED_SQL,
        "",
        " ".join(FS),
        "SELECT " + ", ".join(f"m_{f} AS {f}" for f in FS) + " FROM mine",
    ),
)
def _profile(t):
    return recommend.build_profile(t.catalogue, t.liked, PARTS)


@query(
    "prf7_scaled_space",
    outer(SCALED_SQL, "p_partkey", " ".join(f"s_{f}" for f in FS), "SELECT * FROM scaled"),
)
def _scaled(t):
    taste = recommend.learn_taste(t.catalogue, t.liked, spec=PARTS)
    return t.catalogue.select("p_partkey", *[taste.scaled(f).alias(f"s_{f}") for f in FS])


def _raw(method: str, kind: str):
    def run(t):
        taste = recommend.learn_taste(t.catalogue, t.liked, kind, PARTS)
        return t.catalogue.select("p_partkey", taste.raw_score(method).alias("raw_score"))

    return run


for _name, _method, _kind in (
    ("prf8_cosine_scores", "cosine", "uniform"),
    ("prf9_euclidean_scores", "euclidean", "uniform"),
    ("prf9_euclidean_scores_weighted", "euclidean", "inverse_variance"),
):
    query(_name, outer(score_sql(_method, _kind), "p_partkey", "raw_score", "SELECT * FROM scores"))(
        _raw(_method, _kind)
    )


@query(
    "prf10_weights",
    outer(
        f"{SCALED_SQL},\n{weights_sql('inverse_variance')}",
        "feature",
        "weight",
        "\nUNION ALL ".join(f"SELECT '{f}' AS feature, w_{f} AS weight FROM weights" for f in FS),
    ),
)
def _weights(t):
    taste = recommend.learn_taste(t.catalogue, t.liked, "inverse_variance", PARTS)
    return t.spark.createDataFrame([(f, float(w)) for f, w in taste.weight.items()], "feature string, weight double")


@query(
    "prf11_normalized_scores",
    outer(score_sql("cosine", "uniform"), "p_partkey", "preference_score", "SELECT * FROM scores"),
)
def _normalized(t):
    taste = recommend.learn_taste(t.catalogue, t.liked, spec=PARTS)
    return recommend.score(t.catalogue, taste).select("p_partkey", "preference_score")


@query(
    "prf12_recommend_cosine",
    outer(
        score_sql("cosine", "uniform"),
        SHOWN,
        "demand preference_score",
        f"SELECT * FROM ({BEST_SQL}) ORDER BY preference_score DESC, p_partkey LIMIT 20",
    ),
)
def _cosine(t):
    return recommend.recommend(t.catalogue, t.liked, 20, spec=PARTS)


@query(
    "prf12_recommend_euclidean_weighted",
    outer(
        score_sql("euclidean", "inverse_variance"),
        SHOWN,
        "demand preference_score",
        f"SELECT * FROM ({BEST_SQL}) ORDER BY preference_score DESC, p_partkey LIMIT 20",
    ),
)
def _euclidean(t):
    return recommend.recommend(t.catalogue, t.liked, 20, method="euclidean", weights="inverse_variance", spec=PARTS)


@query(
    "prf12_recommend_all_rows",
    outer(score_sql("euclidean", "uniform"), SHOWN, "demand preference_score", "SELECT * FROM scores"),
)
def _everything(t):
    return recommend.recommend(
        t.catalogue, t.liked, method="euclidean", exclude_liked=False, deduplicate=False, spec=PARTS
    )


@query(
    "prf13_top_matches",
    outer(score_sql("cosine", "uniform"), "p_partkey top_matches", "", "SELECT * FROM scores"),
)
def _matches(t):
    taste = recommend.learn_taste(t.catalogue, t.liked, spec=PARTS)
    return t.catalogue.select("p_partkey", taste.top_matches("cosine").alias("top_matches"))


@query(
    "prf13_top_matches_weighted",
    outer(score_sql("euclidean", "inverse_variance"), "p_partkey top_matches", "", "SELECT * FROM scores"),
)
def _matches_weighted(t):
    taste = recommend.learn_taste(t.catalogue, t.liked, "inverse_variance", PARTS)
    return t.catalogue.select("p_partkey", taste.top_matches("euclidean").alias("top_matches"))


EXPLAINED = "track_raw profile_raw track_scaled profile_scaled delta abs_delta weight attribution"
EXPLAIN_ROWS = "\nUNION ALL ".join(
    f"""SELECT '{f}' AS feature, {f} AS track_raw, m_{f} AS profile_raw, s_{f} AS track_scaled, p_{f} AS profile_scaled,
    s_{f} - p_{f} AS delta, abs(s_{f} - p_{f}) AS abs_delta, w_{f} AS weight,
    -w_{f} * (s_{f} - p_{f}) * (s_{f} - p_{f}) AS attribution
    FROM scaled, mine, weights WHERE p_partkey = (SELECT max(p_partkey) FROM catalogue)"""
    for f in FS
)
EXPLAIN_CTES = f"{SCALED_SQL},\n{weights_sql('inverse_variance')},\nexplained AS ({EXPLAIN_ROWS})"


def _last(t):
    return t.catalogue.agg(F.max("p_partkey")).first()[0]


@query("prf14_explain", outer(EXPLAIN_CTES, "feature", EXPLAINED, "SELECT * FROM explained"))
def _explain(t):
    return recommend.explain(t.catalogue, t.liked, _last(t), "euclidean", "inverse_variance", PARTS)


@query(
    "prf15_explain_top",
    outer(
        EXPLAIN_CTES,
        "feature bucket",
        EXPLAINED,
        """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY abs_delta, feature) AS a,
          row_number() OVER (ORDER BY abs_delta DESC, feature DESC) AS b FROM explained) r
        JOIN (SELECT unnest(['matches', 'mismatches']) AS bucket)
          ON (bucket = 'matches' AND a <= 2) OR (bucket = 'mismatches' AND b <= 2)""",
    ),
)
def _explain_top(t):
    return recommend.explain_top(t.catalogue, t.liked, _last(t), 2, "euclidean", "inverse_variance", PARTS)


@query(
    "prf16_seed_items",
    outer(
        PARTS_SQL,
        SHOWN,
        "demand",
        "SELECT * FROM catalogue ORDER BY demand DESC, p_partkey LIMIT 5",
    ),
)
def _seeds(t):
    return recommend.seeds(t.catalogue, 5, PARTS).select(*SHOWN.split(), "demand")


LOADED = "SELECT DISTINCT o_custkey AS p_partkey FROM orders"


def _saved(t):
    """Ids written and read back; some of them are no parts."""
    ids = t.orders.select(F.col("o_custkey").alias("p_partkey")).distinct()
    path = io.save_liked(ids, scratch(t.spark), PARTS)
    return io.load_liked(t.spark, path, PARTS).select(F.col("p_partkey").cast("long"))


def _cheap(t):
    return t.part.filter("p_retailprice < 980")


@query(
    "snk9_liked_known",
    f"SELECT p_partkey FROM ({LOADED}) WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_retailprice < 980)",
)
def _known(t):
    return recommend.known_ids(_saved(t), _cheap(t), PARTS)


@query(
    "snk10_liked_unknown",
    f"SELECT p_partkey FROM ({LOADED}) WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_retailprice < 980)",
)
def _unknown(t):
    return recommend.unknown_ids(_saved(t), _cheap(t), PARTS)



