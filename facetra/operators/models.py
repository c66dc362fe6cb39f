"""Model fits with MLlib, tuning, cross-validation, importances."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scale import compact, shared_folder, side_by_side
from .forest import Forest, grow
from .metrics import binary_metrics, class_metrics, regression_metrics, top_k_accuracy
from .prepare import balanced_weights, category_statistic, encoder, labels_of, ordered_statistic

# Hyper-parameters and search grids.
DEPTH_LIMIT = 30  # deepest tree MLlib grows; stands in for "no limit"
FOREST = {"numTrees": 300, "maxDepth": DEPTH_LIMIT, "featureSubsetStrategy": "sqrt", "seed": 42}
NODE_IDS = {"cacheNodeIds": True, "checkpointInterval": 10}  # rows keep the node they are in: no job carries the trees grown so far
COMPARISON_FOREST = {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 3, "featureSubsetStrategy": "all", "seed": 42}
BOOSTED = {"maxIter": 300, "stepSize": 0.08, "maxDepth": 6, "seed": 42}
PART_TREES, PART_THREADS = 20, 8  # trees of a part of a forest, and parts grown side by side
CHECKPOINT_EVERY = 10  # boosting rounds between two written states, so that lineage stays short
LOGISTIC_ITERATIONS = 1000
GRID = {
    "numTrees": [100, 200, 300, 500],
    "maxDepth": [None, 10, 20, 30],
    "minSamplesSplit": [2, 5, 10],
    "featureSubsetStrategy": ["sqrt", "log2"],
}


def assembler(inputs: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(inputs), outputCol="features")


def _fit(stages: list, train: DataFrame) -> PipelineModel:
    """The caller keeps ``train``; iterative MLlib fits keep their own form of it meanwhile."""
    return Pipeline(stages=stages).fit(train)


def feature_stages(numeric: Sequence[str], category: str | None, labels: Sequence[str] = (), drop_first: bool = True, scaled: bool = False) -> list:
    """Assembled (optionally scaled) numbers and the encoded category."""
    stages: list = []
    inputs = list(numeric)
    if scaled and numeric:
        stages += [
            VectorAssembler(inputCols=inputs, outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        ]
        inputs = ["scaled"]
    if category:
        stages += encoder(category, labels, drop_first)
        inputs.append(f"{category}_vec")
    return [*stages, assembler(inputs)]


def fit_linear(train: DataFrame, target: str, stages: list, prediction: str = "prediction") -> PipelineModel:
    """Ordinary least squares."""
    ols = LinearRegression(labelCol=target, predictionCol=prediction, regParam=0.0, solver="auto")
    return _fit([*stages, ols], train)


def _grow(stages: list, train: DataFrame, forest, params: dict) -> PipelineModel:
    """``forest`` over features that are made once: one tree a task, or in parts where rows are too many for that.

    :func:`forest.grow` takes rows that tasks can hold as bins. Beyond that MLlib grows parts with seeds of their
    own, some side by side; a part that fails or loses an executor is grown again alone by Spark's retries.
    """
    settings = {**FOREST, **params}
    trees, seed = settings.pop("numTrees"), settings.pop("seed")
    front = _fit(stages, train)
    used = [c for c in ("weight", forest.getLabelCol()) if c in train.columns or c == forest.getLabelCol()]
    held = compact(front.transform(train).select("features", *used))
    sizes = [min(PART_TREES, trees - at) for at in range(0, trees, PART_TREES)]

    def part(i: int) -> Model:
        return forest.copy().setParams(numTrees=sizes[i], seed=seed + i, **{**NODE_IDS, **settings}).fit(held)

    try:
        grown = grow(held, forest.copy().setParams(numTrees=trees, seed=seed, **{**NODE_IDS, **settings}), PART_TREES)
        if grown is None:
            parts = side_by_side(part, range(len(sizes)), PART_THREADS)
            grown = parts[0] if len(parts) == 1 else Forest(parts, forest.getPredictionCol())
    finally:
        held.unpersist()
    return PipelineModel([*front.stages, grown])


def fit_forest_regressor(train: DataFrame, target: str, stages: list, prediction: str = "prediction", **params) -> PipelineModel:
    return _grow(stages, train, RandomForestRegressor(labelCol=target, predictionCol=prediction), params)


def fit_boosted_regressor(train: DataFrame, target: str, numeric: Sequence[str], category: str | None, key: Sequence[str] | None = None, prediction: str = "prediction", **params) -> PipelineModel:
    """Gradient-boosted trees; the category enters as an ordered statistic of the target.

    Rows of the fit get :func:`prepare.ordered_statistic` in the order of a hash of ``key`` (all columns
    of the fit unless given), so that no row's own target is among its features; rows to be
    scored get the statistic over all rows of the fit.
    """
    stages: list = []
    inputs = list(numeric)
    data = train
    if category:
        name = f"{category}_statistic"
        stages.append(category_statistic(train, category, target, name))
        data = ordered_statistic(train, category, target, list(key or [*numeric, category, target]), name)
        inputs.append(name)
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(train.sparkSession))
    boosted = GBTRegressor(
        labelCol=target,
        predictionCol=prediction,
        checkpointInterval=CHECKPOINT_EVERY,
        **{**BOOSTED, **params},
    )
    gather = assembler(inputs)
    held = compact(gather.transform(data).select("features", target))
    try:
        grown = boosted.fit(held)
    finally:
        held.unpersist()
    return PipelineModel([*stages, gather, grown])


def fit_logistic(train: DataFrame, label: str, features: Sequence[str]) -> PipelineModel:
    """Binary logistic regression, balanced classes, unit L2 penalty."""
    weighted = balanced_weights(train, label)
    n = train.count()
    lr = LogisticRegression(
        labelCol=label,
        weightCol="weight",
        regParam=1.0 / n,
        standardization=False,
        maxIter=LOGISTIC_ITERATIONS,
    )
    return _fit([assembler(features), lr], weighted)


def fit_forest_classifier(train: DataFrame, label: str, features: Sequence[str], weight: str | None = None, **params) -> PipelineModel:
    forest = RandomForestClassifier(labelCol=label)
    if weight:
        forest = forest.setWeightCol(weight)
    return _grow([assembler(features)], train, forest, params)


def _category_index(label: str, train: DataFrame) -> StringIndexerModel:
    return StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc").fit(train)


def _fit_classes(stages: list, train: DataFrame) -> PipelineModel:
    """Fitted on known labels only; a scored row may have a label that the fit has not seen."""
    model = _fit(stages, train)
    model.stages[0].setHandleInvalid("keep")
    return model


def fit_logistic_classes(train: DataFrame, label: str, features: Sequence[str]) -> PipelineModel:
    """Multinomial logistic regression on scaled features, balanced classes."""
    train = train.filter(F.col(label).isNotNull())
    weighted = balanced_weights(train, label)
    n = train.count()
    lr = LogisticRegression(
        labelCol="label_index",
        featuresCol="scaled",
        weightCol="weight",
        family="multinomial",
        regParam=1.0 / n,
        standardization=False,
        maxIter=LOGISTIC_ITERATIONS,
    )
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return _fit_classes([_category_index(label, train), assembler(features), scaler, lr], weighted)


def fit_forest_classes(train: DataFrame, label: str, features: Sequence[str], **params) -> PipelineModel:
    """Balanced multi-class forest."""
    train = train.filter(F.col(label).isNotNull())
    weighted = balanced_weights(train, label)
    forest = RandomForestClassifier(labelCol="label_index", weightCol="weight")
    model = _grow([_category_index(label, train), assembler(features)], weighted, forest, params)
    model.stages[0].setHandleInvalid("keep")
    return model


def predict_classes(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """Predicted label text in ``out`` and the probabilities in ``<out>_scores``."""
    labels = model.stages[0].labels
    scored = model.transform(df)
    names = F.array(*[F.lit(v) for v in labels])
    at = F.col("prediction").cast("int") + 1
    text = F.when(at <= len(labels), F.element_at(names, F.least(at, F.lit(len(labels)))))
    return scored.withColumn(out, text).withColumn(f"{out}_scores", vector_to_array("probability"))


def hit_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """P(class 1) as a plain column."""
    if not model.stages[-1].hasParam("probabilityCol"):
        raise TypeError("the model gives no probabilities")
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def class_scores(model: PipelineModel, test: DataFrame, label: str, name: str, k: int = 3) -> DataFrame:
    """One row: accuracy, top-k accuracy, macro and weighted F1."""
    scored = predict_classes(model, test, "predicted").select(label, "predicted", "label_index", "predicted_scores")
    flat = class_metrics(scored, label, "predicted")
    top = top_k_accuracy(scored, "label_index", "predicted_scores", k)
    row = {**flat.first().asDict(), **top.first().asDict()}
    return test.sparkSession.createDataFrame(
        [(name, row["accuracy"], row["top_k_accuracy"], row["macro_f1"], row["weighted_f1"])],
        "model string, accuracy double, top_k_accuracy double, macro_f1 double, weighted_f1 double",
    )


def importances(model: PipelineModel, data: DataFrame, top_n: int | None = None) -> DataFrame:
    """Feature importances of the last stage with the assembled slot names."""
    scored = PipelineModel(model.stages[:-1]).transform(data.limit(0))
    attrs = scored.schema["features"].metadata["ml_attr"]["attrs"]
    named = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(((n, float(values[i])) for i, n in named), key=lambda r: (-r[1], r[0]))
    spark = data.sparkSession
    return spark.createDataFrame(rows[:top_n], "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def cross_validate(
    data: DataFrame,
    folds: int,
    fit: Callable[[DataFrame], Model],
    score: Callable[[DataFrame], DataFrame],
    threads: int = 2,
) -> DataFrame:
    """One row of scores per fold; ``data`` has a ``fold`` column."""
    held = data.persist()
    try:
        rows, schema = _folds(held, folds, fit, score, threads)
        return data.sparkSession.createDataFrame(rows, schema)
    finally:
        held.unpersist()


def _folds(held: DataFrame, folds: int, fit: Callable, score: Callable, threads: int) -> tuple[list[tuple], StructType]:
    """Scores of every fold of rows that the caller keeps."""

    def one(i: int):
        model = fit(held.filter(F.col("fold") != i).drop("fold"))
        scores = score(model.transform(held.filter(F.col("fold") == i).drop("fold")))
        return tuple(scores.first()), scores.schema

    done = side_by_side(one, range(folds), threads)
    return [row for row, _ in done], done[0][1]


def cv_regression(data: DataFrame, target: str, folds: int, fit) -> DataFrame:
    each = cross_validate(data, folds, fit, lambda d: regression_metrics(d, target, "prediction"))
    return each.agg(
        F.avg("rmse").alias("cv_rmse_mean"),
        F.stddev_pop("rmse").alias("cv_rmse_std"),
        F.avg("r2").alias("cv_r2_mean"),
    )


def cv_binary(data: DataFrame, label: str, folds: int, fit) -> DataFrame:
    each = cross_validate(data, folds, fit, lambda d: binary_metrics(d, label, "prediction"))
    return each.agg(
        F.avg("accuracy").alias("cv_accuracy_mean"),
        F.stddev_pop("accuracy").alias("cv_accuracy_std"),
        F.avg("f1").alias("cv_f1_mean"),
    )


def sample_candidates(grid: dict, n: int, seed: int) -> list[dict]:
    """``n`` settings of the grid without replacement, or all of them."""
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


def forest_settings(candidate: dict) -> dict:
    """Grid names to MLlib parameters."""
    out = dict(candidate)
    if "maxDepth" in out:
        out["maxDepth"] = DEPTH_LIMIT if out["maxDepth"] is None else out["maxDepth"]
    if "minSamplesSplit" in out:
        out["minInstancesPerNode"] = math.ceil(out.pop("minSamplesSplit") / 2)
    return out


def tune(
    data: DataFrame,
    folds: int,
    fit: Callable[..., Model],
    score: Callable[[DataFrame], DataFrame],
    metric: str,
    larger_is_better: bool,
    grid: dict | None = None,
    n_iter: int = 20,
    seed: int = 42,
    threads: int = 4,
) -> dict:
    """Randomised search: every candidate on every fold, best one refit on all rows.

    The rows are kept once for all candidates, and ``threads`` candidates are fitted side by side.

    ``data`` has a ``fold`` column; ``fit(train, **params)`` returns a model.
    Scores are larger-is-better, so an error metric enters negated.
    """
    sign = 1.0 if larger_is_better else -1.0
    held = data.persist()

    def tried(candidate: dict) -> tuple:
        params = forest_settings(candidate)
        rows, schema = _folds(held, folds, lambda t: fit(t, **params), score, 1)
        values = np.array([r[schema.fieldNames().index(metric)] for r in rows], float)
        return candidate, sign * values.mean(), values.std()

    try:
        results = side_by_side(tried, sample_candidates(grid or GRID, n_iter, seed), threads)
    finally:
        held.unpersist()
    results.sort(key=lambda r: -r[1])
    rows, rank = [], 0
    for i, (candidate, mean, std) in enumerate(results):
        if i == 0 or mean != results[i - 1][1]:
            rank = i + 1
        rows.append((str(candidate), float(mean), float(std), rank))
    best = results[0]
    table = data.sparkSession.createDataFrame(
        rows, "params string, mean_test_score double, std_test_score double, rank_test_score int"
    )
    return {
        "best_model": fit(data.drop("fold"), **forest_settings(best[0])),
        "best_params": best[0],
        "best_score": float(best[1]),
        "results": table,
    }


def tune_forest_regressor(data: DataFrame, target: str, stages: list, folds: int = 5, **search) -> dict:
    return tune(
        data,
        folds,
        lambda t, **p: fit_forest_regressor(t, target, stages, **p),
        lambda d: regression_metrics(d, target, "prediction"),
        "rmse",
        larger_is_better=False,
        **search,
    )


def tune_forest_classifier(data: DataFrame, label: str, features: Sequence[str], folds: int = 5, **search) -> dict:
    """Tuned with balanced class weights and the F1 score."""

    def fit(train: DataFrame, **params) -> PipelineModel:
        weighted = balanced_weights(train, label)
        return fit_forest_classifier(weighted, label, features, weight="weight", **params)

    return tune(
        data,
        folds,
        fit,
        lambda d: binary_metrics(d, label, "prediction"),
        "f1",
        larger_is_better=True,
        **search,
    )


__all__ = [n for n in dir() if n.startswith(("fit_", "tune", "cv_"))] + [
    "class_scores",
    "hit_probability",
    "importances",
    "labels_of",
    "predict_classes",
]
