import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetra.operators import metrics, models, prepare, split
from facetra.plans import runs
from facetra.sources import persist
from facetra.spec import TRACKS

SMALL = {"numTrees": 5, "maxDepth": 4, "featureSubsetStrategy": "all"}


def test_split_ignores_partitions(spark):
    df = spark.range(500)
    a = {r["id"] for r in split.hash_split(df.repartition(1), ["id"]).filter("is_test").collect()}
    b = {r["id"] for r in split.hash_split(df.repartition(9), ["id"]).filter("is_test").collect()}
    assert a == b and 60 < len(a) < 140


@pytest.mark.parametrize("narrowing", [{}, {"bins": 8, "leaf_rows": 5}])
def test_stratified_split_is_exact(spark, narrowing):
    df = spark.range(300).withColumn("y", F.when(F.col("id") % 10 == 0, "rare").otherwise("usual"))
    got = split.stratified_split(df, ["id"], "y", 0.2, **narrowing)
    counts = {(r["y"], r["is_test"]): r["count"] for r in got.groupBy("y", "is_test").count().collect()}
    assert counts == {("rare", True): 6, ("rare", False): 24, ("usual", True): 54, ("usual", False): 216}


def test_regression_imputation(tracks):
    df = tracks({"popularity": None}, {"track_genre": None, "energy": None}, {"energy": 0.2})
    got = prepare.impute_regression(df).collect()
    assert len(got) == 2 and {r["track_genre"] for r in got} == {"unknown", "folk"}
    assert {r["energy"] for r in got} == {0.2}


def test_classification_imputation(tracks):
    got = prepare.impute_classification(tracks({"explicit": None, "tempo": None}, {"tempo": 100}, {"tempo": 110}))
    assert got.filter("explicit = false").count() == 3
    assert got.filter("tempo = 105").count() == 1


def test_medians_come_from_train(spark):
    rows = [(1, None, False), (2, 0.2, False), (3, 0.4, False), (4, None, True), (5, 0.95, True)]
    df = spark.createDataFrame(rows, "id int, danceability double, is_test boolean")
    got = {r["id"]: r["danceability"] for r in prepare.impute_from_train(df, ["danceability"]).collect()}
    assert got[1] == pytest.approx(0.3) and got[4] == pytest.approx(0.3) and got[5] == 0.95


def test_one_hot_and_encoder_agree(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([("a",), ("b",), ("c",), ("zz",)], "g string")
    flat = prepare.dummies(df.withColumn("x", F.col("g")), "g", ["a", "b", "c"])
    want = {r["x"]: [r["g_b"], r["g_c"]] for r in flat.collect()}
    got = Pipeline(stages=prepare.encoder("g", ["a", "b", "c"])).fit(df).transform(df)
    for r in got.select("g", vector_to_array("g_vec").alias("v")).collect():
        assert [int(v) for v in r["v"]] == want[r["g"]]
    assert want["a"] == want["zz"] == [0, 0]


def test_frequent_labels(tracks):
    df = tracks({}, {}, {"track_genre": "rare"}, {"track_genre": None})
    assert prepare.keep_frequent(df, "track_genre", 2).count() == 2
    with pytest.raises(ValueError, match="at least 5"):
        prepare.keep_frequent(df, "track_genre", 5)


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "y string")
    got = {r["y"]: r["weight"] for r in prepare.balanced_weights(df, "y").collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": 2.0}


HITS = (88, 71, 12, 93, 40, 55, 70, 34, 79)


def _hits(tracks):
    rows = [{"track_id": f"t{i}", "popularity": p, "energy": p / 100, "tempo": 60 + 2 * p} for i, p in enumerate(HITS)]
    return prepare.hit_label(prepare.numeric_flag(tracks(*rows)))


def test_hit_profiles_and_distances(tracks):
    df = _hits(tracks)
    assert df.filter("is_hit = 1").count() == 5
    profiles = prepare.hit_profiles(df)
    diffs = prepare.profile_differences(profiles).collect()
    assert diffs[0]["feature"] == "tempo" and diffs[0]["direction"] == "higher in hits"
    assert len(diffs) == 14
    with pytest.raises(ValueError, match="both"):
        prepare.hit_profiles(df.filter("is_hit = 1"))
    centre = {r["is_hit"]: np.array([r[c] for c in TRACKS.class_features]) for r in profiles.collect()}
    for r in prepare.similarity_features(df, profiles).collect():
        x = np.array([float(r[c]) for c in TRACKS.class_features])
        near, far = np.linalg.norm(x - centre[1]), np.linalg.norm(x - centre[0])
        assert r["distance_to_hit"] == pytest.approx(near)
        assert r["hit_distance_advantage"] == pytest.approx(far - near)
        assert r["hit_closeness_ratio"] == pytest.approx(near / (far + 1e-9))


def test_missing_target_is_no_hit(tracks):
    assert prepare.hit_label(tracks({"popularity": None})).first()["is_hit"] == 0


def test_comparison_data(tracks):
    df = tracks({"popularity": 0}, {"energy": None}, {"popularity": 5})
    assert prepare.comparison_data(df).count() == 1


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (4.0, 3.0)], "y double, p double")
    got = metrics.regression_metrics(df, "y", "p").first()
    assert got["rmse"] == pytest.approx(math.sqrt(2 / 3)) and got["mae"] == pytest.approx(2 / 3)
    assert got["r2"] == pytest.approx(1 - 2 / (14 / 3))
    flat = metrics.regression_metrics(df.withColumn("y", F.lit(1.0)), "y", "p").first()
    assert flat["r2"] is None


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "y int, p int")
    got = metrics.binary_metrics(df, "y", "p").first()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"]) == (0.6, 0.5, 0.5, 0.5)
    none = metrics.binary_metrics(df.withColumn("p", F.lit(0)), "y", "p").first()
    assert none["precision"] == none["recall"] == none["f1"] == 0.0


def test_class_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("a", "d")]
    df = spark.createDataFrame(rows, "y string, p string")
    got = metrics.class_metrics(df, "y", "p").first()
    f1 = {"a": 0.5, "b": 0.5, "c": 0.0, "d": 0.0}
    assert got["accuracy"] == 0.4 and got["macro_f1"] == pytest.approx(sum(f1.values()) / 4)
    assert got["weighted_f1"] == pytest.approx((3 * 0.5 + 0.5) / 5)
    square = metrics.confusion_matrix(df, "y", "p", ["a", "b", "c", "d"]).collect()
    assert [[r[f"pred_{c}"] for c in "abcd"] for r in square] == [[1, 1, 0, 1], [0, 1, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0]]


def test_top_k(spark):
    df = spark.createDataFrame([(0, [0.5, 0.3, 0.2]), (2, [0.5, 0.3, 0.2]), (1, [0.2, 0.2, 0.6])], "y int, s array<double>")
    share = lambda k: metrics.top_k_accuracy(df, "y", "s", k).first()[0]
    assert share(1) == pytest.approx(1 / 3) and share(2) == pytest.approx(1 / 3)
    assert share(3) == 1.0 and share(99) == 1.0


def test_threshold_curve(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.4), float(rng.random())) for _ in range(200)] + [(1, 0.5), (0, 0.05)]
    df = spark.createDataFrame(rows, "y int, s double")
    curve = metrics.threshold_curve(df, "y", "s").collect()
    assert len(curve) == 91
    for r in curve[::10]:
        got = metrics.binary_metrics(metrics.with_threshold(df, "s", r["threshold"]), "y", "predicted").first()
        assert all(r[m] == pytest.approx(got[m]) for m in metrics.METRICS)
    best = metrics.optimal_threshold(metrics.threshold_curve(df, "y", "s")).first()
    assert best["f1"] == max(r["f1"] for r in curve)
    assert best["threshold"] == min(r["threshold"] for r in curve if r["f1"] == best["f1"])
    ends = metrics.threshold_curve(df, "y", "s", [0.0, 1.01]).collect()
    assert ends[0]["recall"] == 1.0 and ends[1]["recall"] == 0.0
    with pytest.raises(ValueError, match="no such metric"):
        metrics.optimal_threshold(df, "auc")


def test_comparison_is_rounded_half_even(spark):
    df = spark.createDataFrame([("b", 7.00004, 0.98765432), ("a", 2.5, 0.5)], "model string, rmse double, r2 double")
    got = metrics.compare_results(df, "rmse", True).collect()
    assert [r["model"] for r in got] == ["a", "b"] and got[1]["rmse"] == 7.0 and got[1]["r2"] == 0.9877


def test_candidates():
    every = models.sample_candidates(models.GRID, 1000, 1)
    assert len(every) == 96
    some = models.sample_candidates(models.GRID, 20, 1)
    assert len({str(c) for c in some}) == 20 and some == models.sample_candidates(models.GRID, 20, 1)
    got = models.forest_settings({"maxDepth": None, "minSamplesSplit": 5})
    assert got == {"maxDepth": 30, "minInstancesPerNode": 3}


def _songs(tracks):
    genres = {"ska": (0.85, 66), "dub": (0.5, 88), "fado": (0.2, 31)}
    return tracks(
        *[
            {
                "track_id": f"{g}-{i}",
                "track_genre": g,
                "energy": e + 0.03 * math.sin(i),
                "tempo": 70 + 90 * e + 2 * math.sin(3 * i),
                "popularity": p + 4 * math.sin(5 * i),
            }
            for g, (e, p) in genres.items()
            for i in range(18)
        ]
    )


def test_regression_run(tracks, tmp_path):
    got = runs.popularity_models(_songs(tracks), folds=2, **SMALL)
    rows = {r["model"]: r for r in got["comparison"].collect()}
    assert set(rows) == {"Linear Regression", "Random Forest"}
    assert all(r["rmse"] < 12 and r["cv_rmse_mean"] > 0 for r in rows.values())
    assert set(got["predictions"].columns) == {"track_id", "actual", "linear_prediction", "random_forest_prediction"}
    assert got["feature_importance"].count() <= 10
    paths = runs.save_run("popularity", got, str(tmp_path))
    assert len(paths) == 3


def test_hit_run(tracks):
    got = runs.hit_models(_songs(tracks), 60, folds=2, **SMALL)
    assert all(r["accuracy"] >= 0.8 for r in got["comparison"].collect())
    assert got["feature_importance"].count() == 4 and got["profiles"].count() == 2


def test_category_run(tracks):
    got = runs.category_models(_songs(tracks), 10, **SMALL)
    for r in got["comparison"].collect():
        assert r["macro_f1"] > 0.8 and r["top_k_accuracy"] >= r["accuracy"]
    assert got["confusion_matrix"].count() == 3


def test_three_model_run(tracks):
    got = runs.compare_three(_songs(tracks), forest=SMALL, boosted={"maxIter": 3, "maxDepth": 3})
    rows = got["results"].collect()
    assert [r["model"] for r in rows][0] == got["best_model"] and len(rows) == 3


def test_tuning(tracks):
    data = split.fold_ids(_songs(tracks), ["track_id"], 2)
    stages = [models.assembler(["energy", "tempo"])]
    grid = {"numTrees": [2, 3], "maxDepth": [2, None], "minSamplesSplit": [2]}
    got = models.tune_forest_regressor(data, "popularity", stages, 2, grid=grid, n_iter=2)
    rows = got["results"].collect()
    assert [r["rank_test_score"] for r in rows] == [1, 2] and got["best_score"] == rows[0]["mean_test_score"] <= 0
    hits = prepare.hit_label(data, 60)
    best = models.tune_forest_classifier(hits, "is_hit", ["energy", "tempo"], 2, grid=grid, n_iter=1)
    assert best["best_score"] > 0.8


def test_model_round_trip(spark, tracks, tmp_path):
    songs = _songs(tracks)
    model = models.fit_linear(songs, "popularity", [models.assembler(["energy"])])
    path = str(tmp_path / "model")
    persist.save_model(spark, model, path, {"target": "popularity", "model_class": "mine"})
    back, meta = persist.load_model(spark, path)
    assert meta["target"] == "popularity" and meta["model_class"] == "mine" and "trained_at_utc" in meta
    a = [r["prediction"] for r in model.transform(songs).take(3)]
    assert a == [r["prediction"] for r in back.transform(songs).take(3)]
    bare = str(tmp_path / "bare")
    model.save(bare)
    assert persist.load_model(spark, bare)[1] is None


def test_empty_input_is_refused(tracks):
    with pytest.raises(ValueError, match="no rows"):
        runs.popularity_models(tracks({}).limit(0))
    with pytest.raises(ValueError, match="tempo"):
        runs.popularity_models(tracks({}).drop("tempo"))
