"""Checked queries: model preparation, fits, metrics, clusters and scenarios."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ..operators import cluster, metrics, models, prepare, scenario, split
from ..sources import persist
from . import runs
from .bindings import DIMS, ITEMS, ITEMS_SQL, PARTS, PARTS_SQL, VECTORS, VECTORS_SQL, scratch
from .registry import outer, query

KEEP = "l_orderkey l_linenumber"


def hash_sql(*key: str, seed: int | str = 42, digits: int = 8) -> str:
    parts = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"CAST('0x' || substr(md5('{seed}|' || {parts}), 1, {digits}) AS BIGINT)"


# imputation, encoding, splits ------------------------------------------------------

HOLES_SQL = f"""{ITEMS_SQL},
holes AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 <> 0 THEN line_group END AS line_group,
  CASE WHEN l_orderkey % 13 <> 0 THEN l_extendedprice END AS l_extendedprice,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS l_discount, l_tax,
  CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity > 25 END AS is_bulk FROM items)"""
FLAGGED = ITEMS.with_roles(flag="is_bulk")


def _holes(t) -> DataFrame:
    def hole(c, n):
        return F.when(F.col("l_orderkey") % n != 0, c)

    return t.items.select(
        "l_orderkey",
        "l_linenumber",
        hole(F.col("line_group"), 11).alias("line_group"),
        hole(F.col("l_extendedprice"), 13).alias("l_extendedprice"),
        hole(F.col("l_quantity"), 7).alias("l_quantity"),
        hole(F.col("l_discount"), 5).alias("l_discount"),
        "l_tax",
        hole(F.col("l_quantity") > 25, 3).alias("is_bulk"),
    )


def filled_sql(source: str, train: str = "true") -> str:
    middle = lambda c: f"(SELECT quantile_cont({c}, 0.5) FROM {source} WHERE {train})"
    return ", ".join(f"coalesce({c}, {middle(c)}) AS {c}" for c in ("l_quantity", "l_discount", "l_tax"))


NUMBERS = "l_extendedprice l_quantity l_discount l_tax"
WITH_TARGET = f"{HOLES_SQL},\nrated AS (SELECT * FROM holes WHERE l_extendedprice IS NOT NULL)"


@query(
    "mdl2_impute_regression",
    outer(
        WITH_TARGET,
        f"{KEEP} line_group",
        NUMBERS,
        f"""SELECT l_orderkey, l_linenumber, coalesce(line_group, 'unknown') AS line_group, l_extendedprice,
        {filled_sql("rated")} FROM rated""",
    ),
)
def _impute_regression(t):
    return prepare.impute_regression(_holes(t).drop("is_bulk"), ITEMS)


@query(
    "mdl3_impute_classification",
    outer(
        WITH_TARGET,
        f"{KEEP} line_group is_bulk",
        NUMBERS,
        f"""SELECT l_orderkey, l_linenumber, line_group, l_extendedprice, coalesce(is_bulk, false) AS is_bulk,
        {filled_sql("rated")} FROM rated""",
    ),
)
def _impute_classification(t):
    return prepare.impute_classification(_holes(t), FLAGGED)


SPLIT = hash_sql("l_orderkey", "l_linenumber", seed="split:42", digits=12) + f" < {math.floor(0.2 * 16**12)}"


@query(
    "mdl4_impute_from_train",
    outer(
        f"{HOLES_SQL},\nsplit AS (SELECT *, {SPLIT} AS is_test FROM holes)",
        f"{KEEP} is_test",
        "l_quantity l_discount l_tax",
        f"SELECT l_orderkey, l_linenumber, is_test, {filled_sql('split', 'NOT is_test')} FROM split",
    ),
)
def _impute_train(t):
    data = split.hash_split(_holes(t), ITEMS.key)
    cols = ["l_quantity", "l_discount", "l_tax"]
    return prepare.impute_from_train(data, cols).select(*KEEP.split(), "is_test", *cols)


GROUPS = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query(
    "mdl5_one_hot",
    f"WITH {ITEMS_SQL} SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"CAST(line_group = '{g}' AS INTEGER) AS \"line_group_{g}\"" for g in GROUPS[1:])
    + " FROM items",
)
def _one_hot(t):
    labels = prepare.labels_of(t.items, "line_group")
    rows = prepare.dummies(t.items, "line_group", labels)
    return rows.select(*KEEP.split(), *[f"line_group_{g}" for g in labels[1:]])


@query(
    "mdl7_model_columns",
    outer(
        PARTS_SQL,
        "p_partkey is_large",
        "p_size p_retailprice avg_quantity avg_discount avg_tax total_quantity n_lines demand",
        """SELECT p_partkey, CAST(is_large AS INTEGER) AS is_large, p_size, p_retailprice, avg_quantity, avg_discount,
        avg_tax, total_quantity, n_lines, demand FROM catalogue""",
    ),
)
def _model_columns(t):
    return prepare.numeric_flag(prepare.drop_identifiers(t.catalogue, PARTS), PARTS)


@query("mdl8_hash_split", f"SELECT l_orderkey, l_linenumber, {SPLIT} AS is_test FROM lineitem")
def _split(t):
    return split.hash_split(t.lineitem.select(*KEEP.split()), ITEMS.key)


ORDER_HASH = hash_sql("o_orderkey", seed="split:42", digits=12)


@query(
    "mdl9_stratified_split",
    f"""WITH hashed AS (SELECT o_orderkey, o_orderpriority, {ORDER_HASH} AS h FROM orders)
SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h)
  <= ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.2::DOUBLE) AS is_test FROM hashed""",
)
def _stratified(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return split.stratified_split(rows, ["o_orderkey"], "o_orderpriority")


@query(
    "mdl10_frequent_labels",
    """SELECT p_partkey, p_name FROM part WHERE p_name IN (
    SELECT p_name FROM part GROUP BY p_name HAVING count(*) >= 32)""",
)
def _frequent(t):
    return prepare.keep_frequent(t.part.select("p_partkey", "p_name"), "p_name", 32)


PART_HASH = hash_sql("p_partkey", seed="split:42", digits=12)


@query(
    "mdl11_category_data",
    outer(
        f"""{PARTS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {PART_HASH})
  <= ceil(count(*) OVER (PARTITION BY p_brand) * 0.2::DOUBLE) AS is_test FROM catalogue)""",
        "p_brand is_test n",
        "p_size avg_quantity",
        """SELECT p_brand, is_test, count(*) AS n, avg(p_size) AS p_size, avg(avg_quantity) AS avg_quantity
        FROM ranked WHERE p_brand IN (SELECT p_brand FROM catalogue GROUP BY p_brand HAVING count(*) >= 50)
        GROUP BY p_brand, is_test""",
    ),
)
def _category_data(t):
    data = runs.category_data(t.catalogue, 50, PARTS.with_roles(category="p_brand"))
    return data.groupBy("p_brand", "is_test").agg(
        F.count("*").alias("n"), F.avg("p_size").alias("p_size"), F.avg("avg_quantity").alias("avg_quantity")
    )


# labels and class profiles ---------------------------------------------------------

HIT = 52
PROFILE = [*PARTS.profile_features, "n_lines"]
HIT_SQL = f"{PARTS_SQL},\nhits AS (SELECT *, CAST(demand >= {HIT} AS INTEGER) AS is_hit FROM catalogue)"
MEANS_SQL = f"""{HIT_SQL},
means AS (SELECT is_hit, {", ".join(f"avg({c}) AS {c}" for c in PROFILE)} FROM hits GROUP BY is_hit),
pair AS (SELECT {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in PROFILE)}
  FROM means a, means b WHERE a.is_hit = 0 AND b.is_hit = 1)"""


def _hits(t):
    return prepare.hit_label(t.catalogue, HIT, PARTS)


@query("mdl12_hit_label", f"WITH {HIT_SQL} SELECT p_partkey, is_hit FROM hits")
def _hit_label(t):
    return _hits(t).select("p_partkey", "is_hit")


@query("mdl13_hit_profiles", outer(MEANS_SQL, "is_hit", " ".join(PROFILE), "SELECT * FROM means"))
def _profiles(t):
    return prepare.hit_profiles(_hits(t), PROFILE, PARTS)


@query(
    "mdl14_profile_differences",
    outer(
        MEANS_SQL,
        "feature direction",
        "non_hit_mean hit_mean difference absolute_difference",
        "\nUNION ALL ".join(
            f"""SELECT '{c}' AS feature, a_{c} AS non_hit_mean, b_{c} AS hit_mean, b_{c} - a_{c} AS difference,
            abs(b_{c} - a_{c}) AS absolute_difference,
            CASE WHEN b_{c} > a_{c} THEN 'higher in hits' ELSE 'lower in hits' END AS direction FROM pair"""
            for c in PROFILE
        ),
    ),
)
def _differences(t):
    return prepare.profile_differences(prepare.hit_profiles(_hits(t), PROFILE, PARTS))


def _norm(side: str) -> str:
    return "sqrt(" + " + ".join(f"({c} - {side}_{c}) * ({c} - {side}_{c})" for c in PROFILE) + ")"


SIMILAR_SQL = f"""{MEANS_SQL},
distances AS (SELECT p_partkey, is_hit, {_norm("a")} AS distance_to_non_hit, {_norm("b")} AS distance_to_hit
  FROM hits, pair),
nearness AS (SELECT *, distance_to_non_hit - distance_to_hit AS hit_distance_advantage,
  distance_to_hit / (distance_to_non_hit + 1e-9) AS hit_closeness_ratio FROM distances)"""


@query(
    "mdl15_similarity_features",
    outer(SIMILAR_SQL, "p_partkey is_hit", " ".join(prepare.SIMILARITY), "SELECT * FROM nearness"),
)
def _similar(t):
    profiles = prepare.hit_profiles(_hits(t), PROFILE, PARTS)
    rows = prepare.similarity_features(_hits(t), profiles)
    return rows.select("p_partkey", "is_hit", *prepare.SIMILARITY)


@query(
    "mdl16_model_frame", outer(SIMILAR_SQL, "is_hit", " ".join(prepare.SIMILARITY), "SELECT * FROM nearness")
)
def _frame(t):
    profiles = prepare.hit_profiles(_hits(t), PROFILE, PARTS)
    return prepare.modeling_frame(prepare.similarity_features(_hits(t), profiles))


@query(
    "mdl23_balanced_weights",
    outer(
        "",
        "o_orderkey o_orderpriority",
        "weight",
        """SELECT o_orderkey, o_orderpriority, (SELECT count(*) / count(DISTINCT o_orderpriority) FROM orders)
        / count(*) OVER (PARTITION BY o_orderpriority) AS weight FROM orders""",
    ),
)
def _weights(t):
    return prepare.balanced_weights(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query(
    "mdl25_comparison_data",
    outer(
        HOLES_SQL,
        f"{KEEP} line_group",
        NUMBERS,
        """SELECT * FROM holes WHERE line_group IS NOT NULL AND l_extendedprice > 0 AND l_quantity IS NOT NULL
        AND l_discount IS NOT NULL AND l_tax IS NOT NULL""",
    ),
)
def _comparison(t):
    return prepare.comparison_data(_holes(t), ITEMS)


# metrics ------------------------------------------------------------------------------


def _guesses(t) -> DataFrame:
    return t.items.select(
        *KEEP.split(), "line_group", "l_extendedprice", (F.col("l_quantity") * 1500).alias("guess")
    )


@query(
    "mdl28_regression_metrics",
    outer(
        f"{ITEMS_SQL},\nguesses AS (SELECT *, l_extendedprice - l_quantity * 1500 AS e FROM items)",
        "line_group",
        "rmse mae r2",
        """SELECT line_group, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
        1 - sum(e * e) / (count(*) * var_pop(l_extendedprice)) AS r2 FROM guesses GROUP BY line_group""",
    ),
)
def _regression_metrics(t):
    return metrics.regression_metrics(_guesses(t), "l_extendedprice", "guess", ["line_group"])


def _labelled(t) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey",
        (F.col("l_extendedprice") >= 50000).cast("int").alias("y"),
        (F.col("l_quantity") / 50).alias("score"),
    )


LABELLED_SQL = """labelled AS (SELECT l_orderkey, CAST(l_extendedprice >= 50000 AS INTEGER) AS y,
  l_quantity / 50 AS score FROM lineitem)"""


def scores_sql(tp: str, fp: str, fn: str, tn: str) -> str:
    return f"""coalesce(({tp} + {tn}) / nullif(({tp} + {fp} + {fn} + {tn})::DOUBLE, 0), 0) AS accuracy,
      coalesce({tp} / nullif(({tp} + {fp})::DOUBLE, 0), 0) AS precision,
      coalesce({tp} / nullif(({tp} + {fn})::DOUBLE, 0), 0) AS recall,
      coalesce(2 * {tp} / nullif((2 * {tp} + {fp} + {fn})::DOUBLE, 0), 0) AS f1"""


COUNTS = (
    "count_if(y = 1 AND {p})",
    "count_if(y = 0 AND {p})",
    "count_if(y = 1 AND NOT {p})",
    "count_if(y = 0 AND NOT {p})",
)
SCORES = "accuracy precision recall f1"


@query(
    "mdl29_binary_metrics",
    outer(
        LABELLED_SQL,
        "",
        SCORES,
        "SELECT " + scores_sql(*[c.format(p="score >= 0.6::DOUBLE") for c in COUNTS]) + " FROM labelled",
    ),
)
def _binary(t):
    return metrics.binary_metrics(metrics.with_threshold(_labelled(t), "score", 0.6), "y", "predicted")


CLASSES_SQL = """classes AS (SELECT l_linenumber AS actual, CAST(l_quantity AS INTEGER) % 7 + 1 AS predicted FROM lineitem),
labels AS (SELECT DISTINCT actual AS label FROM classes UNION SELECT DISTINCT predicted FROM classes),
each AS (SELECT label, count_if(actual = label AND predicted = label) AS tp, count_if(actual = label) AS support,
  count_if(predicted = label) AS guessed FROM labels, classes GROUP BY label),
f AS (SELECT *, coalesce(2 * tp / nullif((support + guessed)::DOUBLE, 0), 0) AS f1 FROM each)"""


def _classes(t) -> DataFrame:
    return t.lineitem.select(
        F.col("l_linenumber").alias("actual"),
        (F.col("l_quantity").cast("int") % 7 + 1).alias("predicted"),
    )


@query(
    "mdl30_class_metrics",
    outer(
        CLASSES_SQL,
        "",
        "accuracy macro_f1 weighted_f1",
        """SELECT sum(tp) / sum(support)::DOUBLE AS accuracy, avg(f1) AS macro_f1,
        sum(f1 * support) / sum(support)::DOUBLE AS weighted_f1 FROM f""",
    ),
)
def _class_metrics(t):
    return metrics.class_metrics(_classes(t), "actual", "predicted")


@query(
    "mdl31_top_k_accuracy",
    outer(
        "",
        "",
        "top_k_accuracy",
        """SELECT avg(CAST(above < 3 AS DOUBLE)) AS top_k_accuracy FROM (
          SELECT e.vec_id, e.label, count_if(s.v > own OR (s.v = own AND s.i < e.label)) AS above
          FROM (SELECT *, embedding[label + 1] AS own FROM embeddings) e,
            LATERAL (SELECT unnest(embedding) AS v, unnest(range(64)) AS i) s
          GROUP BY e.vec_id, e.label)""",
    ),
)
def _top_k(t):
    rows = t.embeddings.select("label", F.col("embedding").alias("scores"))
    return metrics.top_k_accuracy(rows, "label", "scores", 3)


@query(
    "mdl32_confusion_matrix",
    f"WITH {CLASSES_SQL.split(',' + chr(10))[0]} SELECT actual, "
    + ", ".join(f"CAST(count_if(predicted = {i}) AS BIGINT) AS pred_{i}" for i in range(1, 8))
    + " FROM classes GROUP BY actual",
)
def _confusion(t):
    rows = _classes(t)
    labels = prepare.labels_of(rows.select("actual").union(rows.select("predicted")), "actual")
    return metrics.confusion_matrix(rows, "actual", "predicted", labels)


@query(
    "mdl33_fold_ids",
    f"SELECT o_orderkey, CAST({hash_sql('o_orderkey', seed='fold:42', digits=12)} % 5 AS INTEGER) AS fold FROM orders",
)
def _folds(t):
    return split.fold_ids(t.orders.select("o_orderkey"), ["o_orderkey"])


@query(
    "mdl35_compare_models",
    outer(
        f"{ITEMS_SQL},\nguesses AS (SELECT *, l_extendedprice - l_quantity * 1500 AS e FROM items)",
        "model",
        "rmse mae r2",
        """SELECT line_group AS model, round_even(sqrt(avg(e * e)), 4) AS rmse, round_even(avg(abs(e)), 4) AS mae,
        round_even(1 - sum(e * e) / (count(*) * var_pop(l_extendedprice)), 4) AS r2 FROM guesses GROUP BY line_group""",
    ),
)
def _compare(t):
    got = metrics.regression_metrics(_guesses(t), "l_extendedprice", "guess", ["line_group"])
    return metrics.compare_results(got.withColumnRenamed("line_group", "model"), "rmse", True)


@query(
    "mdl38_threshold_predictions",
    f"WITH {LABELLED_SQL} SELECT l_orderkey, y, CAST(score >= 0.3::DOUBLE AS INTEGER) AS predicted FROM labelled",
)
def _predict(t):
    return metrics.with_threshold(_labelled(t), "score", 0.3).drop("score")


CURVE_SQL = f"""{LABELLED_SQL},
cuts AS (SELECT CASE WHEN i = 90 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE + i * ((0.95::DOUBLE - 0.05::DOUBLE) / 90) END
  AS threshold FROM range(91) r(i)),
curve AS (SELECT threshold, {scores_sql(*[c.format(p="score >= threshold") for c in COUNTS])}
  FROM labelled, cuts GROUP BY threshold)"""


@query("mdl39_threshold_curve", outer(CURVE_SQL, "", f"threshold {SCORES}", "SELECT * FROM curve"))
def _curve(t):
    return metrics.threshold_curve(_labelled(t), "y", "score")


@query(
    "mdl40_optimal_threshold",
    outer(CURVE_SQL, "", f"threshold {SCORES}", "SELECT * FROM curve ORDER BY f1 DESC, threshold LIMIT 1"),
)
def _optimal(t):
    return metrics.optimal_threshold(metrics.threshold_curve(_labelled(t), "y", "score"))


@query(
    "mdl44_prediction_summary",
    outer(
        LABELLED_SQL,
        "total actual_hits predicted_hits",
        "actual_rate predicted_rate",
        """SELECT count(*) AS total, CAST(count_if(y = 1) AS BIGINT) AS actual_hits,
        CAST(count_if(score >= 0.6::DOUBLE) AS BIGINT) AS predicted_hits,
        count_if(y = 1) / count(*)::DOUBLE AS actual_rate,
        count_if(score >= 0.6::DOUBLE) / count(*)::DOUBLE AS predicted_rate FROM labelled""",
    ),
)
def _summary(t):
    return metrics.prediction_summary(metrics.with_threshold(_labelled(t), "score", 0.6), "y", "predicted")


# fits ------------------------------------------------------------------------------------

SMALL = {"numTrees": 10, "maxDepth": 5}  # for the bench, and where six forests are fitted: README has the times
_GROWN: dict[tuple, object] = {}


def _stages(t, train) -> list:
    return models.feature_stages(
        ["p_size", "p_retailprice", "avg_quantity", "avg_discount", "avg_tax"],
        "p_type",
        prepare.labels_of(train, "p_type"),
    )


def _train_test(t):
    return split.train_test(split.hash_split(t.catalogue, PARTS.key))


@query(
    "mdl17_linear_fit",
    outer(
        f"""{ITEMS_SQL}, split AS (SELECT *, {SPLIT} AS is_test FROM items),
line AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
  FROM split WHERE NOT is_test)""",
        "line_group n",
        "mean_prediction",
        """SELECT line_group, count(*) AS n, round(avg(a + b * l_quantity), 3) AS mean_prediction
        FROM split, line WHERE is_test GROUP BY line_group""",
    ),
)
def _linear(t):
    train, test = split.train_test(split.hash_split(t.items, ITEMS.key))
    model = models.fit_linear(train, "l_extendedprice", [models.assembler(["l_quantity"])])
    return model.transform(test).groupBy("line_group").agg(
        F.count("*").alias("n"), F.round(F.avg("prediction"), 3).alias("mean_prediction")
    )


# One tree on one 0/1 feature, grown on all rows, predicts the mean of the feature's group.
ONE_TREE = {"numTrees": 1, "bootstrap": False, "maxDepth": 1, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"}
BULK_SQL = f"""{ITEMS_SQL}, split AS (SELECT *, CAST(l_quantity > 25 AS DOUBLE) AS bulk, l_extendedprice > 40000 AS dear, {SPLIT} AS is_test FROM items)"""


def _bulk(t):
    """Items with a 0/1 feature and a 0/1 label, split by key."""
    rows = t.items.withColumn("bulk", (F.col("l_quantity") > 25).cast("double"))
    rows = rows.withColumn("dear", (F.col("l_extendedprice") > 40000).cast("int"))
    return split.train_test(split.hash_split(rows, ITEMS.key))


@query(
    "mdl18_one_tree",
    outer(
        BULK_SQL,
        KEEP,
        "prediction",
        """SELECT l_orderkey, l_linenumber, g.prediction FROM split JOIN (
          SELECT bulk, avg(l_extendedprice) AS prediction FROM split WHERE NOT is_test GROUP BY bulk) g USING (bulk) WHERE is_test""",
    ),
)
def _one_tree(t):
    train, test = _bulk(t)
    model = models.fit_forest_regressor(train, "l_extendedprice", [models.assembler(["bulk"])], **ONE_TREE)
    return model.transform(test).select(*KEEP.split(), "prediction")


@query(
    "mdl24_one_round",
    outer(
        BULK_SQL,
        KEEP,
        "prediction",
        """SELECT l_orderkey, l_linenumber, g.prediction FROM split JOIN (
          SELECT bulk, avg(l_extendedprice) AS prediction FROM split WHERE NOT is_test GROUP BY bulk) g USING (bulk) WHERE is_test""",
    ),
)
def _one_round(t):
    train, test = _bulk(t)
    model = models.fit_boosted_regressor(train, "l_extendedprice", ["bulk"], None, maxIter=1, maxDepth=1)
    return model.transform(test).select(*KEEP.split(), "prediction")


@query(
    "mdl36_one_tree_importance",
    outer("", "feature", "importance", "SELECT 'bulk' AS feature, CAST(1 AS DOUBLE) AS importance FROM lineitem LIMIT 1"),
)
def _one_importance(t):
    train, _ = _bulk(t)
    model = models.fit_forest_regressor(train, "l_extendedprice", [models.assembler(["bulk"])], **ONE_TREE)
    return models.importances(model, train)


@query(
    "mdl19_balanced_mean",
    outer(
        "",
        "rows_scored",
        "weighted_mean",
        """SELECT count(*) AS rows_scored, CAST(0.5 AS DOUBLE) AS weighted_mean FROM lineitem""",
    ),
)
def _balanced_mean(t):
    """With balanced weights the mean score over the rows of the fit, weighed alike, is one half."""
    train, test = _bulk(t)
    both = train.unionByName(test)
    model = models.fit_logistic(both, "dear", ["bulk"])
    scored = prepare.balanced_weights(models.hit_probability(model, both), "dear")
    mean = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    return scored.agg(F.count("*").alias("rows_scored"), F.round(mean, 3).alias("weighted_mean"))


@query(
    "mdl33_linear_folds",
    outer(
        f"""{ITEMS_SQL}, folded AS (SELECT *, {hash_sql('l_orderkey', 'l_linenumber', seed='fold:42', digits=12)} % 5 AS fold FROM items),
fits AS (SELECT f.fold, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
  FROM folded JOIN (SELECT unnest(range(5)) AS fold) f ON folded.fold <> f.fold GROUP BY f.fold),
scored AS (SELECT fold, sqrt(avg((l_extendedprice - a - b * l_quantity) ** 2)) AS rmse,
  1 - sum((l_extendedprice - a - b * l_quantity) ** 2) / (count(*) * var_pop(l_extendedprice)) AS r2
  FROM folded JOIN fits USING (fold) GROUP BY fold)""",
        "",
        "cv_rmse_mean cv_rmse_std cv_r2_mean",
        "SELECT round(avg(rmse), 3) AS cv_rmse_mean, round(stddev_pop(rmse), 3) AS cv_rmse_std, round(avg(r2), 5) AS cv_r2_mean FROM scored",
    ),
)
def _linear_folds(t):
    folded = split.fold_ids(t.items, ITEMS.key, 5)
    fit = lambda d: models.fit_linear(d, "l_extendedprice", [models.assembler(["l_quantity"])])
    got = models.cv_regression(folded, "l_extendedprice", 5, fit)
    return got.select(F.round("cv_rmse_mean", 3).alias("cv_rmse_mean"), F.round("cv_rmse_std", 3).alias("cv_rmse_std"), F.round("cv_r2_mean", 5).alias("cv_r2_mean"))


@query(
    "mdl33_stratified_folds",
    outer(
        "",
        "o_orderstatus folds_used widest_gap",
        "",
        """SELECT o_orderstatus, CAST(least(5, count(*)) AS BIGINT) AS folds_used,
        CAST(CASE WHEN count(*) % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS widest_gap FROM orders GROUP BY o_orderstatus""",
    ),
)
def _stratified(t):
    """Sizes of the folds of a class differ by one row at most."""
    folded = split.fold_ids(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 5, label="o_orderstatus")
    sizes = folded.groupBy("o_orderstatus", "fold").count()
    return sizes.groupBy("o_orderstatus").agg(
        F.count("*").alias("folds_used"), (F.max("count") - F.min("count")).cast("long").alias("widest_gap")
    )


@query(
    "mdl37_linear_predictions",
    outer(
        f"""{BULK_SQL}, line AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
  FROM split WHERE NOT is_test)""",
        KEEP,
        "actual linear_prediction",
        """SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, round(a + b * l_quantity, 2) AS linear_prediction
        FROM split, line WHERE is_test""",
    ),
)
def _linear_predictions(t):
    train, test = _bulk(t)
    model = models.fit_linear(train, "l_extendedprice", [models.assembler(["l_quantity"])], "linear_prediction")
    rounded = F.round("linear_prediction", 2).alias("linear_prediction")
    return model.transform(test).select(*KEEP.split(), F.col("l_extendedprice").alias("actual"), rounded)


@query(
    "mdl8_small_share",
    f"""WITH {ITEMS_SQL} SELECT l_orderkey, l_linenumber,
    {hash_sql('l_orderkey', 'l_linenumber', seed='split:42', digits=12)} < {math.floor(0.004 * 16**12)} AS is_test FROM items""",
)
def _small_share(t):
    return split.hash_split(t.items, ITEMS.key, 0.004).select(*KEEP.split(), "is_test")


@query(
    "mdl9_repeated_keys",
    """SELECT o_orderstatus, count(*) * 3 AS n, CAST(ceil(count(*) * 3 * 0.2) AS BIGINT) AS n_test FROM orders GROUP BY o_orderstatus""",
)
def _repeated_keys(t):
    """Every key three times: the count of test rows still is the documented one."""
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    split_rows = split.stratified_split(rows.unionByName(rows).unionByName(rows), ["o_orderkey"], "o_orderstatus")
    return split_rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


def _grown(t):
    """The forest of 300 trees on the parts' train rows, grown once for a session and folder."""
    key = (t.spark.sparkContext.applicationId, t.directory)
    if key not in _GROWN:
        _GROWN.clear()
        train, _ = _train_test(t)
        _GROWN[key] = models.fit_forest_regressor(train, "demand", _stages(t, train))
    return _GROWN[key]


@query("mdl18_forest_fit")
def _forest(t):
    _, test = _train_test(t)
    return _grown(t).transform(test).select("p_partkey", "demand", "prediction")


@query("mdl18_forest_10_trees")
def _forest_of_ten(t):
    train, test = _train_test(t)
    model = models.fit_forest_regressor(train, "demand", _stages(t, train), **SMALL)
    return model.transform(test).select("p_partkey", "demand", "prediction")


PART_SPLIT = hash_sql("p_partkey", seed="split:42", digits=12) + f" < {math.floor(0.2 * 16**12)}"


@query(
    "mdl18_forest_bounds",
    f"""WITH {PARTS_SQL}, split AS (SELECT *, {PART_SPLIT} AS is_test FROM catalogue)
SELECT p_partkey, true AS within, CAST(300 AS BIGINT) AS trees FROM split WHERE is_test""",
)
def _forest_bounds(t):
    """Every prediction of 300 trees lies between the smallest and the largest target of the fit."""
    train, test = _train_test(t)
    low, high = train.agg(F.min("demand"), F.max("demand")).first()
    model = _grown(t)
    within = F.col("prediction").between(low - 1e-9, high + 1e-9)
    return model.transform(test).select("p_partkey", within.alias("within"), F.lit(len(model.stages[-1].trees)).cast("long").alias("trees"))


@query(
    "mdl36_importance_sum",
    outer(
        f"""{PARTS_SQL}, split AS (SELECT *, {PART_SPLIT} AS is_test FROM catalogue)""",
        "features",
        "total",
        "SELECT count(DISTINCT p_type) + 4 AS features, CAST(1 AS DOUBLE) AS total FROM split WHERE NOT is_test",
    ),
)
def _importance_sum(t):
    """Importances of all slots: five numbers and one a category but the first."""
    train, _ = _train_test(t)
    return models.importances(_grown(t), train).agg(F.count("*").alias("features"), F.sum("importance").alias("total"))


ORDER_SQL = f"""{ITEMS_SQL}, mean AS (SELECT avg(l_quantity) AS m FROM items),
ordered AS (SELECT *, {hash_sql('l_orderkey', 'l_linenumber', seed='order:42', digits=12)} AS place FROM items)"""


@query(
    "mdl24_ordered_statistic",
    outer(
        ORDER_SQL,
        KEEP,
        "statistic",
        """SELECT l_orderkey, l_linenumber, (coalesce(sum(l_quantity) OVER earlier, 0) + m) / (count(*) OVER earlier + 1) AS statistic
        FROM ordered, mean WINDOW earlier AS (PARTITION BY line_group ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
)
def _ordered_statistic(t):
    rows = prepare.ordered_statistic(t.items, "line_group", "l_quantity", ITEMS.key, "statistic")
    return rows.select(*KEEP.split(), "statistic")


@query(
    "mdl24_category_statistic",
    outer(
        f"{BULK_SQL}, mean AS (SELECT avg(l_quantity) AS m FROM split WHERE NOT is_test AND line_group <> 'RF')",
        KEEP,
        "statistic",
        """SELECT l_orderkey, l_linenumber, coalesce((s + m) / (n + 1), m) AS statistic FROM mean, split LEFT JOIN (
          SELECT line_group, sum(l_quantity) AS s, count(*) AS n FROM split WHERE NOT is_test AND line_group <> 'RF' GROUP BY line_group)
        USING (line_group) WHERE is_test""",
    ),
)
def _category_statistic(t):
    """Statistics of the train rows for the test rows, of which one category is unknown to the fit."""
    train, test = _bulk(t)
    stage = prepare.category_statistic(train.filter("line_group <> 'RF'"), "line_group", "l_quantity", "statistic")
    return stage.transform(test).select(*KEEP.split(), "statistic")


@query("mdl19_logistic_fit")
def _logistic(t):
    train, test = split.train_test(split.stratified_split(_hits(t), PARTS.key, "is_hit"))
    model = models.fit_logistic(train, "is_hit", PROFILE)
    return models.hit_probability(model, test).select("p_partkey", "is_hit", "score")


@query("mdl20_forest_classifier_fit")
def _forest_classifier(t):
    train, test = split.train_test(split.stratified_split(_hits(t), PARTS.key, "is_hit"))
    model = models.fit_forest_classifier(train, "is_hit", PROFILE)
    return models.hit_probability(model, test).select("p_partkey", "is_hit", "score")


@query("mdl21_logistic_classes_fit")
def _logistic_classes(t):
    train, test = split.train_test(split.stratified_split(t.vectors, ["vec_id"], "label"))
    text = F.col("label").cast("string")
    model = models.fit_logistic_classes(train.withColumn("label", text), "label", VECTORS.features)
    return models.class_scores(model, test.withColumn("label", text), "label", "Logistic Regression")


@query("mdl22_forest_classes_fit")
def _forest_classes(t):
    train, test = split.train_test(split.stratified_split(t.vectors, ["vec_id"], "label"))
    text = F.col("label").cast("string")
    model = models.fit_forest_classes(train.withColumn("label", text), "label", VECTORS.features)
    return models.class_scores(model, test.withColumn("label", text), "label", "Random Forest")


@query("mdl24_boosted_fit")
def _boosted(t):
    train, test = _train_test(t)
    model = models.fit_boosted_regressor(
        train,
        "demand",
        ["p_size", "p_retailprice", "avg_quantity", "avg_tax"],
        "p_type",
        PARTS.key,
    )
    return model.transform(test).select("p_partkey", "demand", "prediction")


@query("mdl27_three_models")
def _three(t):
    got = runs.compare_three(t.catalogue, PARTS)
    return got["results"].withColumn("best", F.col("model") == got["best_model"])


@query("mdl33_cross_validation")
def _cross(t):
    train, _ = _train_test(t)
    stages = _stages(t, train)
    folded = split.fold_ids(train, PARTS.key, 5)
    return models.cv_regression(folded, "demand", 5, lambda d: models.fit_linear(d, "demand", stages))


@query("mdl34_tuned_forest")
def _tuned(t):
    train, _ = _train_test(t)
    grid = {"numTrees": [3, 5], "maxDepth": [2, 3], "minSamplesSplit": [2, 5], "featureSubsetStrategy": ["sqrt"]}
    folded = split.fold_ids(train, PARTS.key, 2)
    return models.tune_forest_regressor(folded, "demand", _stages(t, train), 2, grid=grid, n_iter=2)["results"]


@query("mdl36_feature_importance")
def _importance(t):
    train, _ = _train_test(t)
    return models.importances(_grown(t), train, 10)


@query("mdl41_target_models")
def _target_models(t):
    return runs.popularity_models(t.catalogue, PARTS, folds=5, **SMALL)["comparison"]


@query("mdl42_hit_models")
def _hit_models(t):
    return runs.hit_models(t.catalogue, HIT, PARTS, folds=5, **SMALL)["comparison"]


@query("mdl43_category_models")
def _category_models(t):
    return runs.category_models(t.catalogue, 50, PARTS)["comparison"]


@query("mdl37_predictions_with_key")
def _predictions(t):
    train, test = _train_test(t)
    stages = _stages(t, train)
    model = models.fit_linear(train, "demand", stages, "linear_prediction")
    return model.transform(test).select("p_partkey", F.col("demand").alias("actual"), "linear_prediction")


@query(
    "snk7_model_roundtrip",
    outer(
        ITEMS_SQL,
        "line_group",
        "mean_prediction",
        """SELECT line_group, round(avg(a + b * l_quantity), 3) AS mean_prediction FROM items, (
          SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
          FROM items) GROUP BY line_group""",
    ),
)
def _model_roundtrip(t):
    model = models.fit_linear(t.items, "l_extendedprice", [models.assembler(["l_quantity"])])
    path = persist.save_model(t.spark, model, scratch(t.spark), {"target": "l_extendedprice"})["model"]
    back, _ = persist.load_model(t.spark, path)
    return back.transform(t.items).groupBy("line_group").agg(
        F.round(F.avg("prediction"), 3).alias("mean_prediction")
    )


# clusters ----------------------------------------------------------------------------------

SCALED = [f"{c}_scaled" for c in ITEMS.features]


@query(
    "clu1_scaled_features",
    outer(
        f"""{HOLES_SQL}, whole AS (SELECT * FROM holes WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL
  AND l_tax IS NOT NULL)""",
        KEEP,
        " ".join(SCALED),
        "SELECT l_orderkey, l_linenumber, "
        + ", ".join(
            f"({c} - (SELECT avg({c}) FROM whole)) / (SELECT stddev_pop({c}) FROM whole) AS {c}_scaled"
            for c in ITEMS.features
        )
        + " FROM whole",
    ),
)
def _scaled(t):
    rows = _holes(t)
    return cluster.scale(rows, cluster.scaling(rows, ITEMS.features)).select(*KEEP.split(), *SCALED)


# Vectors moved far apart by label: k-means finds the labels again.
APART = [f"e{i}" for i in range(4)]
APART_SQL = (
    "apart AS (SELECT vec_id, label % 3 AS part, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) + CASE WHEN label % 3 = {i} THEN 1000 ELSE 0 END AS e{i}" for i in range(4))
    + " FROM embeddings)"
)


def _apart(t):
    part = F.col("label") % 3
    return t.embeddings.select("vec_id", part.alias("part"), *[(F.col("embedding")[i].cast("double") + F.when(part == i, 1000.0).otherwise(0.0)).alias(c) for i, c in enumerate(APART)])


@query(
    "clu3_separate_groups",
    f"""WITH {APART_SQL}, named AS (SELECT part, min(vec_id) AS name FROM apart GROUP BY part)
    SELECT vec_id, name AS group_name FROM apart JOIN named USING (part)""",
)
def _separate(t):
    """Each row with the smallest id of its cluster; ten starts."""
    placed, _, _ = cluster.assign_clusters(_apart(t), 3, APART, spec=VECTORS)
    names = placed.groupBy("cluster").agg(F.min("vec_id").alias("group_name"))
    return placed.join(names, "cluster").select("vec_id", "group_name")


@query(
    "clu4_separate_centroids",
    outer(APART_SQL, "", " ".join(APART), "SELECT " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in APART) + " FROM apart GROUP BY part"),
)
def _separate_centroids(t):
    _, model, scales = cluster.assign_clusters(_apart(t), 3, APART, spec=VECTORS)
    return cluster.centroids(model, scales, t.spark).select(*[F.round(c, 4).alias(c) for c in APART])


@query(
    "clu2_separate_inertia",
    outer(
        f"""{APART_SQL}, z AS (SELECT part, {", ".join(f"(e{i} - avg(e{i}) OVER ()) / stddev_pop(e{i}) OVER () AS e{i}" for i in range(4))} FROM apart),
gaps AS (SELECT {" + ".join(f"(e{i} - avg(e{i}) OVER (PARTITION BY part)) ** 2" for i in range(4))} AS g FROM z)""",
        "k rows_used",
        "inertia",
        "SELECT 3 AS k, round(sum(g), 3) AS inertia, CAST(least(2000, count(*)) AS BIGINT) AS rows_used FROM gaps",
    ),
)
def _separate_inertia(t):
    got = cluster.find_optimal_k(_apart(t), APART, ["vec_id"], range(3, 4))
    return got.select("k", "rows_used", F.round("inertia", 3).alias("inertia"))


@query("clu2_cluster_search")
def _search(t):
    return cluster.find_optimal_k(t.vectors, VECTORS.features, ["vec_id"])


@query("clu3_assigned_clusters")
def _assigned(t):
    spec = PARTS
    placed, _, _ = cluster.assign_clusters(t.catalogue, 3, spec=spec)
    return placed.select("p_partkey", "cluster")


@query("clu4_centroids")
def _centroids(t):
    _, model, scales = cluster.assign_clusters(t.vectors, 3, spec=VECTORS)
    return cluster.centroids(model, scales, t.spark)


@query(
    "clu5_cluster_summary",
    outer(
        f"""{PARTS_SQL}, placed AS (SELECT *, CAST(p_partkey % 5 AS INTEGER) - 1 AS cluster FROM catalogue),
tops AS (SELECT cluster, p_type AS top_category FROM placed GROUP BY cluster, p_type
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, p_type) = 1)""",
        "cluster size top_category",
        "mean_target " + " ".join(f"mean_{c}" for c in PARTS.features),
        "SELECT cluster, count(*) AS size, avg(demand) AS mean_target, "
        + ", ".join(f"avg({c}) AS mean_{c}" for c in PARTS.features)
        + ", any_value(top_category) AS top_category FROM placed JOIN tops USING (cluster)"
        + " WHERE cluster >= 0 GROUP BY cluster",
    ),
)
def _cluster_summary(t):
    placed = t.catalogue.withColumn("cluster", (F.col("p_partkey") % 5).cast("int") - 1)
    return cluster.cluster_summary(placed, spec=PARTS)


@query("clu6_cluster_tables")
def _cluster_run(t):
    return runs.cluster_run(t.catalogue, 3, spec=PARTS)["summary"]


GAP = "sqrt(" + " + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(DIMS)) + ")"


@query(
    "clu7_silhouette",
    outer(
        f"""{VECTORS_SQL},
sample AS (SELECT * FROM vectors ORDER BY {hash_sql("vec_id")}, vec_id LIMIT 2000),
gaps AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum({GAP}) AS total, count(*) AS n
  FROM sample a, sample b GROUP BY ALL),
sides AS (SELECT vec_id, max(CASE WHEN own = other THEN total / (n - 1) END) AS a,
  min(CASE WHEN own <> other THEN total / n END) AS b FROM gaps GROUP BY vec_id)""",
        "",
        "silhouette rows_used",
        "SELECT avg((b - a) / greatest(a, b)) AS silhouette, CAST(count(*) AS DOUBLE) AS rows_used FROM sides",
    ),
)
def _silhouette(t):
    sample = cluster.exact_sample(t.vectors, ["vec_id"], cluster.SAMPLE_ROWS)
    got = cluster.silhouette(sample, VECTORS.features, "label")
    return got.withColumn("rows_used", F.col("rows_used").cast("double"))


# scenarios ------------------------------------------------------------------------------------

SCENARIOS = {
    "more_discount": {"avg_discount": 0.97},
    "less_tax": {"avg_tax": -0.02},
    "discount_and_size": {"avg_discount": 0.1, "p_size": 5.0, "no_such_column": 1.0},
}


def _linear_score(df: DataFrame) -> DataFrame:
    total = 10 * F.col("avg_discount") + 5 * F.col("avg_tax") + 0.01 * F.col("p_size") - 0.1
    return df.withColumn("prediction", total / 7.3316951)


@query(
    "imp2_feature_changes",
    outer(
        PARTS_SQL,
        "p_partkey",
        "avg_discount avg_tax p_size",
        """SELECT p_partkey, greatest(0, least(1, avg_discount + 0.97::DOUBLE)) AS avg_discount,
        greatest(0, least(1, avg_tax - 0.04::DOUBLE)) AS avg_tax, p_size + 5 AS p_size FROM catalogue""",
    ),
)
def _changes(t):
    changes = {"avg_discount": 0.97, "avg_tax": -0.04, "p_size": 5.0, "no_such_column": 1.0}
    rows = scenario.apply_changes(t.catalogue, changes, PARTS)
    return rows.select("p_partkey", "avg_discount", "avg_tax", "p_size")


@query(
    "imp3_prediction_change",
    outer(
        "",
        "event_id",
        "absolute_change percent_change",
        """SELECT event_id, round_even(value / 7 - user_id, 4) AS absolute_change,
        round_even(coalesce((value / 7 - user_id) / nullif(user_id::DOUBLE, 0) * 100, 0), 4) AS percent_change
        FROM events""",
    ),
)
def _change(t):
    got = scenario.prediction_change(F.col("user_id").cast("double"), F.col("value") / 7)
    return t.events.select("event_id", *[v.alias(k) for k, v in got.items()])


def scenario_sql(name: str, changes: dict) -> str:
    disc, tax, size = (changes.get(c, 0.0) for c in ("avg_discount", "avg_tax", "p_size"))
    text = str(changes).replace("'", "''")
    return f"""SELECT p_partkey, '{name}' AS scenario, '{text}' AS changes,
      (10 * avg_discount + 5 * avg_tax + 0.01::DOUBLE * p_size - 0.1::DOUBLE) / 7.3316951::DOUBLE AS a,
      (10 * greatest(0, least(1, avg_discount + {disc}::DOUBLE)) + 5 * greatest(0, least(1, avg_tax + {tax}::DOUBLE))
      + 0.01::DOUBLE * (p_size + {size}::DOUBLE) - 0.1::DOUBLE) / 7.3316951::DOUBLE AS b FROM catalogue"""


COMPARED_SQL = f"""{PARTS_SQL},
spread AS ({" UNION ALL ".join(scenario_sql(k, v) for k, v in SCENARIOS.items())}),
moved AS (SELECT p_partkey, scenario, changes, round_even(a, 4) AS original_prediction,
  round_even(b, 4) AS modified_prediction, round_even(b - a, 4) AS absolute_change,
  round_even(coalesce((b - a) / nullif(a, 0) * 100, 0), 4) AS percent_change FROM spread)"""
MOVED = "original_prediction modified_prediction absolute_change percent_change"


@query(
    "imp5_compare_scenarios",
    outer(
        COMPARED_SQL,
        "p_partkey scenario changes rank",
        MOVED,
        """SELECT *, CAST(dense_rank() OVER (PARTITION BY p_partkey ORDER BY absolute_change DESC) AS INTEGER) AS rank
        FROM moved""",
    ),
)
def _scenarios(t):
    return scenario.compare_scenarios(t.catalogue, SCENARIOS, _linear_score, ["p_partkey"], spec=PARTS)


@query(
    "imp4_simulated_impact",
    outer(COMPARED_SQL, "", MOVED, "SELECT * FROM moved WHERE scenario = 'more_discount'"),
)
def _simulated(t):
    return scenario.simulate(t.catalogue, SCENARIOS["more_discount"], _linear_score, spec=PARTS)


@query("imp6_model_scenarios")
def _model_scenarios(t):
    return runs.impact_run(t.catalogue, None, SCENARIOS, PARTS)


