"""End-to-end runs: read, prepare, fit, evaluate, write."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import small_copy
from ..operators import analyze, clean, cluster, metrics, models, prepare, profile, scenario, split, validate
from ..sources.tables import load_csv, normalize_names, write_tables
from ..spec import TRACKS, FeatureSpec


def run_cleaning(spark: SparkSession, path: str, spec: FeatureSpec = TRACKS, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """``multiline``: values hold line breaks, so that a file cannot be split."""
    raw = load_csv(spark, path, spec, typed=False, multiline=multiline)
    return clean.clean_data(raw, spec), clean.clean_report(raw, spec)


def run_validation(spark: SparkSession, path: str, spec: FeatureSpec = TRACKS, multiline: bool = False) -> tuple[DataFrame, dict]:
    df = load_csv(spark, path, spec, multiline=multiline)
    validate.validate_schema(df, spec)
    return df, {
        "pair_correlation": validate.pair_correlation(df, spec),
        "report": validate.validation_report(df, spec),
    }


def run_summary(spark: SparkSession, path: str, spec: FeatureSpec = TRACKS, multiline: bool = False) -> tuple[DataFrame, dict]:
    df = load_csv(spark, path, spec, multiline=multiline)
    return df, profile.summarize(df, spec)


def export_summary(df: DataFrame, directory: str, spec: FeatureSpec = TRACKS) -> dict[str, str]:
    tables = {
        "summary_target_correlations": profile.target_correlations(df, spec=spec),
        "summary_category_means": profile.category_summary(df, spec=spec),
        "summary_target_by_category": profile.tier_pivot(df, spec=spec),
        "summary_outliers": profile.detect_outliers(df, spec=spec),
    }
    return write_tables({k: small_copy(v) or v for k, v in tables.items()}, directory)


def run_analysis(
    spark: SparkSession, path: str, spec: FeatureSpec = TRACKS, n_bootstrap: int = 1000, multiline: bool = False
) -> dict:
    cleaned, _ = run_cleaning(spark, path, spec, multiline)
    return analyze.run_analysis(cleaned, spec, n_bootstrap)


def popularity_models(
    df: DataFrame, spec: FeatureSpec = TRACKS, folds: int = 5, seed: int = 42, **forest
) -> dict:
    """Linear and forest regression of the target, compared on held-out rows."""
    target, category = spec.target, spec.category
    prepare.validate_input(df, (target, category, *spec.profile_features))
    cols = [c for c in spec.numeric if c in df.columns and c != target]
    data = df.na.drop(subset=[target]).na.fill(prepare.UNKNOWN, [category])
    data = split.hash_split(data, spec.key, seed=seed)
    data = prepare.impute_from_train(data, cols)
    data = prepare.numeric_flag(data, spec)
    extra = [spec.flag] if spec.flag and spec.flag in data.columns else []
    inputs = [*cols, *extra]
    data = data.select(*spec.key, category, target, "is_test", *inputs).persist()
    try:
        train, test = split.train_test(data)
        labels = prepare.labels_of(train, category)
        stages = models.feature_stages(inputs, category, labels)

        def linear(t, **_):
            return models.fit_linear(t, target, stages)

        def grow(t, **p):
            return models.fit_forest_regressor(t, target, stages, **{**forest, **p})

        folded = split.fold_ids(train, spec.key, folds, seed)
        rows, fitted = [], {}
        for name, fit in (("Linear Regression", linear), ("Random Forest", grow)):
            fitted[name] = fit(train)
            scored = fitted[name].transform(test)
            held = metrics.regression_metrics(scored, target, "prediction")
            crossed = models.cv_regression(folded, target, folds, fit)
            rows.append((name, *held.first(), *crossed.first()))
        schema = (
            "model string, rmse double, mae double, r2 double, "
            "cv_rmse_mean double, cv_rmse_std double, cv_r2_mean double"
        )
        comparison = metrics.compare_results(df.sparkSession.createDataFrame(rows, schema), "rmse", True)
        first = fitted["Linear Regression"].transform(test).withColumnRenamed("prediction", "linear_prediction")
        used = [*test.columns, "linear_prediction"]
        both = fitted["Random Forest"].transform(first.select(*used))
        predictions = both.select(
            *spec.key,
            F.col(target).alias("actual"),
            "linear_prediction",
            F.col("prediction").alias("random_forest_prediction"),
        )
        return {
            "linear_model": fitted["Linear Regression"],
            "random_forest_model": fitted["Random Forest"],
            "comparison": comparison,
            "feature_importance": models.importances(fitted["Random Forest"], train, 10),
            "predictions": predictions,
        }
    finally:
        data.unpersist()


def hit_models(
    df: DataFrame,
    threshold: float = 70,
    spec: FeatureSpec = TRACKS,
    folds: int = 5,
    seed: int = 42,
    scaled: bool = False,
    **forest,
) -> dict:
    """Logistic and forest classification of hits from distances to class profiles.

    Medians and profiles come from train rows only.
    """
    features = [c for c in spec.class_features if c in df.columns]
    prepare.validate_input(df, (spec.target, *features))
    data = prepare.numeric_flag(df.na.drop(subset=[spec.target]), spec)
    data = prepare.hit_label(data, threshold, spec)
    data = split.stratified_split(data, spec.key, "is_hit", seed=seed)
    data = prepare.impute_from_train(data, [c for c in features if c != spec.flag])
    data = data.select(*spec.key, *features, "is_hit", "is_test").persist()
    try:
        train, test = split.train_test(data)
        profiles = prepare.hit_profiles(train, features, spec)
        train_rows = prepare.modeling_frame(prepare.similarity_features(train, profiles, scaled), spec.key)
        test_rows = prepare.modeling_frame(prepare.similarity_features(test, profiles, scaled), spec.key)
        inputs = list(prepare.SIMILARITY)

        def logistic(t, **_):
            return models.fit_logistic(t, "is_hit", inputs)

        def grow(t, **p):
            return models.fit_forest_classifier(t, "is_hit", inputs, **{**forest, **p})

        folded = split.fold_ids(train_rows, spec.key, folds, seed, "is_hit")
        rows, fitted = [], {}
        for name, fit in (("Logistic Regression", logistic), ("Random Forest", grow)):
            fitted[name] = fit(train_rows)
            held = metrics.binary_metrics(fitted[name].transform(test_rows), "is_hit", "prediction")
            crossed = models.cv_binary(folded, "is_hit", folds, fit)
            rows.append((name, *held.first(), *crossed.first()))
        schema = (
            "model string, accuracy double, precision double, recall double, f1 double, "
            "cv_accuracy_mean double, cv_accuracy_std double, cv_f1_mean double"
        )
        predictions = fitted["Random Forest"].transform(test_rows).select(
            *spec.key,
            F.col("is_hit").alias("actual_is_hit"),
            F.col("prediction").cast("int").alias("predicted_is_hit"),
        )
        return {
            "profiles": profiles,
            "differences": prepare.profile_differences(profiles),
            "comparison": metrics.compare_results(df.sparkSession.createDataFrame(rows, schema), "f1"),
            "feature_importance": models.importances(fitted["Random Forest"], train_rows),
            "predictions": predictions,
            "logistic_model": fitted["Logistic Regression"],
            "random_forest_model": fitted["Random Forest"],
        }
    finally:
        data.unpersist()


def category_data(
    df: DataFrame, min_rows: int = 50, spec: FeatureSpec = TRACKS, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Frequent categories only, split per category, imputed from train rows."""
    features = [c for c in spec.class_features if c in df.columns]
    prepare.validate_input(df, (*features, spec.category))
    data = prepare.keep_frequent(df, spec.category, min_rows)
    data = prepare.numeric_flag(data, spec)
    data = split.stratified_split(data, spec.key, spec.category, test_size, seed)
    data = prepare.impute_from_train(data, [c for c in features if c != spec.flag])
    return data.select(*spec.key, spec.category, *features, "is_test")


def category_models(
    df: DataFrame, min_rows: int = 50, spec: FeatureSpec = TRACKS, seed: int = 42, top_k: int = 3, **forest
) -> dict:
    """Logistic and forest classification of the category."""
    label = spec.category
    data = category_data(df, min_rows, spec, seed=seed).persist()
    try:
        train, test = split.train_test(data)
        features = [c for c in spec.class_features if c in data.columns]
        logistic = models.fit_logistic_classes(train, label, features)
        grown = models.fit_forest_classes(train, label, features, **forest)
        results = models.class_scores(logistic, test, label, "Logistic Regression", top_k).unionByName(
            models.class_scores(grown, test, label, "Random Forest", top_k)
        )
        first = models.predict_classes(logistic, test, "logistic_prediction").select(*test.columns, "logistic_prediction")
        both = models.predict_classes(grown, first, "random_forest_prediction").select(
            *spec.key, F.col(label).alias("actual"), "logistic_prediction", "random_forest_prediction"
        )
        labels = prepare.labels_of(data, label)
        return {
            "logistic_model": logistic,
            "random_forest_model": grown,
            "comparison": metrics.compare_results(results, "macro_f1"),
            "confusion_matrix": metrics.confusion_matrix(both, "actual", "random_forest_prediction", labels),
            "predictions": both,
        }
    finally:
        data.unpersist()


def cluster_run(
    df: DataFrame,
    n_clusters: int = 5,
    k_range: Iterable[int] | None = range(2, 11),
    spec: FeatureSpec = TRACKS,
    seed: int = 42,
    restarts: int = cluster.RESTARTS,
) -> dict:
    features = list(spec.features)
    searched = (
        cluster.find_optimal_k(df, features, spec.key, k_range, seed, restarts) if k_range is not None else None
    )
    placed, model, scales = cluster.assign_clusters(df, n_clusters, features, seed, restarts, spec)
    shown = [c for c in (*spec.key, spec.name, spec.owner, spec.category) if c and c in placed.columns]
    return {
        "k_search": searched,
        "model": model,
        "clustered": placed,
        "assignments": placed.filter("cluster >= 0").select(*shown, "cluster"),
        "centroids": cluster.centroids(model, scales, df.sparkSession),
        "summary": cluster.cluster_summary(placed, features, spec),
    }


def compare_three(df: DataFrame, spec: FeatureSpec = TRACKS, seed: int = 42, forest=None, boosted=None) -> dict:
    """Linear, forest and boosted-tree regression on complete rows."""
    df = normalize_names(df)
    category = spec.resolve_category(df)
    data = split.hash_split(prepare.comparison_data(df, spec), spec.key, seed=seed).persist()
    try:
        train, test = split.train_test(data)
        numeric = [c for c in spec.profile_features if c in data.columns]
        labels = prepare.labels_of(train, category) if category else []
        target = spec.target
        fits = {
            "Linear Regression": lambda: models.fit_linear(
                train, target, models.feature_stages(numeric, category, labels, False, scaled=True)
            ),
            "Random Forest": lambda: models.fit_forest_regressor(
                train,
                target,
                models.feature_stages(numeric, category, labels, False),
                **{**models.COMPARISON_FOREST, **(forest or {})},
            ),
            "Boosted Trees": lambda: models.fit_boosted_regressor(
                train, target, numeric, category, spec.key, **(boosted or {})
            ),
        }
        rows, fitted = [], {}
        for name, fit in fits.items():
            fitted[name] = fit()
            got = metrics.regression_metrics(fitted[name].transform(test), target, "prediction").first()
            rows.append((name, *[None if v is None else round(v, 3) for v in got]))
        table = df.sparkSession.createDataFrame(rows, "model string, rmse double, mae double, r2 double")
        best = min(rows, key=lambda r: r[1])[0]
        predictions = fitted[best].transform(test).select(
            *[k for k in spec.key if k in test.columns], F.col(target).alias("actual"), "prediction"
        )
        return {
            "results": table.orderBy("rmse", "model"),
            "best_model": best,
            "models": fitted,
            "predictions": predictions,
        }
    finally:
        data.unpersist()


def impact_run(
    df: DataFrame,
    keys: DataFrame | None = None,
    scenarios=None,
    spec: FeatureSpec = TRACKS,
    seed: int = 42,
    **forest,
) -> DataFrame:
    """Scenario changes of a forest prediction for held-out rows.

    ``keys`` names the rows; by default every test row is scored.
    """
    cols = [c for c in spec.numeric if c in df.columns and c != spec.target]
    prepare.validate_input(df, (spec.target, spec.category, *spec.profile_features))
    data = df.na.drop(subset=[spec.target]).na.fill(prepare.UNKNOWN, [spec.category])
    data = prepare.impute_from_train(split.hash_split(data, spec.key, seed=seed), cols)
    data = prepare.numeric_flag(data, spec)
    cols += [spec.flag] if spec.flag and spec.flag in data.columns else []
    data = data.select(*spec.key, spec.category, spec.target, "is_test", *cols).persist()
    try:
        train, test = split.train_test(data)
        labels = prepare.labels_of(train, spec.category)
        stages = models.feature_stages(cols, spec.category, labels)
        model = models.fit_forest_regressor(train, spec.target, stages, **forest)
        rows = test if keys is None else test.join(keys, list(spec.key), "left_semi")
        if keys is not None and rows.isEmpty():
            raise ValueError("none of the keys is a test row")
        compared = scenario.compare_scenarios(rows, scenarios, model.transform, [*spec.key, spec.target], spec=spec)
        return compared.withColumnRenamed(spec.target, "actual")
    finally:
        data.unpersist()


# Names of the tables each run writes.
WRITTEN = {
    "popularity": {
        "comparison": "popularity_model_comparison",
        "feature_importance": "popularity_feature_importance",
        "predictions": "popularity_predictions",
    },
    "hit": {
        "profiles": "hit_profiles",
        "differences": "hit_profile_differences",
        "comparison": "hit_model_comparison",
        "feature_importance": "hit_similarity_importance",
        "predictions": "hit_predictions",
    },
    "category": {
        "comparison": "category_model_comparison",
        "confusion_matrix": "category_confusion_matrix",
        "predictions": "category_predictions",
    },
    "cluster": {
        "assignments": "cluster_assignments",
        "centroids": "cluster_centroids",
        "summary": "cluster_summary",
        "k_search": "cluster_k_search",
    },
    "comparison": {"results": "model_results", "predictions": "best_model_predictions"},
}


def save_run(kind: str, results: dict, directory: str, fmt: str = "csv") -> dict[str, str]:
    """Write the tables of a run."""
    tables = {name: results.get(part) for part, name in WRITTEN[kind].items()}
    return write_tables(tables, directory, fmt)


def save_impact(results: DataFrame, directory: str, fmt: str = "csv") -> dict[str, str]:
    return write_tables({"feature_impact_results": results}, directory, fmt)
