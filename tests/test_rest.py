"""Clusters, scenarios, chart tables, sources, streaming and joins."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetra.functions.scale import compact, lookup_join, small_copy
from facetra.operators import chartdata, clean, cluster, scenario
from facetra.plans import runs
from facetra.sources import tables as io
from facetra.spec import TRACKS
from facetra.streaming.clean_stream import clean_stream

CENTRES = (("ska", 0.72, 160, 61), ("dub", 0.3, 72, 42), ("fado", 0.5, 112, 27))
EACH = 11


@pytest.fixture
def songs(tracks):
    return tracks(
        *[
            {
                "track_id": f"{g}{i}",
                "track_genre": g,
                "energy": e + 0.02 * np.sin(i).item(),
                "tempo": t + 2 * np.cos(i).item(),
                "popularity": p,
            }
            for g, e, t, p in CENTRES
            for i in range(EACH)
        ],
        {"track_id": "hole", "energy": None},
    )


FS = ["energy", "tempo"]


def test_scaling_uses_population_deviation(songs):
    scales = cluster.scaling(songs, FS)
    got = cluster.scale(songs, scales).agg(F.avg("energy_scaled"), F.stddev_pop("energy_scaled")).first()
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(1)
    assert cluster.scaling(songs, ["loudness"])["loudness"][1] == 1.0
    with pytest.raises(ValueError, match="nope"):
        cluster.scaling(songs, ["nope"])
    with pytest.raises(ValueError, match="No rows"):
        cluster.scaling(songs.withColumn("energy", F.lit(None).cast("double")), FS)


def test_clusters_recover_groups(songs):
    placed, model, scales = cluster.assign_clusters(songs, 3, FS, restarts=3)
    rows = placed.collect()
    assert len(rows) == 3 * EACH + 1 and [r["cluster"] for r in rows if r["track_id"] == "hole"] == [-1]
    pairs = {(r["track_genre"], r["cluster"]) for r in rows if r["cluster"] >= 0}
    assert len(pairs) == 3
    centres = cluster.centroids(model, scales, songs.sparkSession).collect()
    assert sorted(round(r["tempo"], -1) for r in centres) == [70, 110, 160]
    summary = cluster.cluster_summary(placed, FS).collect()
    assert [r["size"] for r in summary] == [EACH] * 3
    assert {r["top_category"] for r in summary} == {"ska", "dub", "fado"}


def test_cluster_search(songs):
    got = cluster.find_optimal_k(songs, FS, ["track_id"], range(2, 5), restarts=2).collect()
    costs = [r["inertia"] for r in got]
    assert costs == sorted(costs, reverse=True)
    assert max(got, key=lambda r: r["silhouette"])["k"] == 3


def test_starts_share_their_passes(spark, songs, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.clustering import KMeans

    data = cluster.vectors(songs.repartition(16), cluster.scaling(songs, FS)).select("features").persist()
    held = compact(data, 20)
    n = data.count()
    assert held.rdd.getNumPartitions() == -(-n // 20) < 16 and held.count() == n
    spark.sparkContext.setJobGroup("passes", "")
    fitted = cluster.fit_each(held, [2, 3, 4], restarts=4)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("passes"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 60 + 3 * 4 * 12  # passes are shared; only the first centres are found fit by fit
    for k, model in fitted.items():
        want = min((KMeans(k=k, maxIter=300, tol=1e-4, seed=42 + i).fit(held) for i in range(4)), key=lambda m: m.summary.trainingCost)
        assert model.cost == pytest.approx(want.summary.trainingCost)
        assert [c.tolist() for c in model.clusterCenters()] == [pytest.approx(c.tolist()) for c in want.clusterCenters()]
        assert model.transform(held).select("prediction").collect() == want.transform(held).select("prediction").collect()
    PipelineModel([fitted[3]]).write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m")).stages[0]
    assert back.cost == fitted[3].cost and (back.centres == fitted[3].centres).all()
    held.unpersist()


def test_silhouette_by_hand(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (5.0, 1), (9.0, 2)], "x double, cluster int")
    # two singletons count 0; the pair: a = 1, b = 5 and 4
    want = ((5 - 1) / 5 + (4 - 1) / 4 + 0 + 0) / 4
    assert cluster.silhouette(df, ["x"]).first()[0] == pytest.approx(want)
    assert cluster.silhouette(df.withColumn("cluster", F.lit(0)), ["x"]).first()[0] is None


def test_top_category_ties_to_smaller_name(tracks):
    df = tracks({"track_genre": "b"}, {"track_genre": "a"}).withColumn("cluster", F.lit(0))
    assert cluster.cluster_summary(df, FS).first()["top_category"] == "a"


# scenarios ----------------------------------------------------------------------------


def scorer(df):
    return df.withColumn("prediction", 20 * F.col("valence") - 10 * F.col("acousticness") + 2)


@pytest.fixture
def one(tracks):
    return tracks({"valence": 0.3, "acousticness": 0.4})


def test_changes_are_clipped(tracks):
    df = scenario.apply_changes(
        tracks({"energy": 0.95, "danceability": None}), {"energy": 0.1, "tempo": 7, "danceability": 0.1, "nope": 1}
    ).first()
    assert df["energy"] == 1.0 and df["tempo"] == 124.0 and df["danceability"] is None


def test_change_numbers(spark):
    rows = [(40.0, 50.0), (16.0, 12.0), (0.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = scenario.prediction_change(F.col("a"), F.col("b"))
    out = [tuple(r) for r in df.select(*[v.alias(k) for k, v in got.items()]).collect()]
    assert out == [(10.0, 25.0), (-4.0, -25.0), (3.0, 0.0)]


def test_simulation(one):
    got = scenario.simulate(one, {"valence": 0.1}, scorer).first()
    assert (got["original_prediction"], got["modified_prediction"]) == (4.0, 6.0)
    assert (got["absolute_change"], got["percent_change"]) == (2.0, 50.0)


def test_scenarios_are_ranked_densely(one):
    plans = {"up": {"valence": 0.1}, "same": {"acousticness": -0.2}, "down": {"acousticness": 0.2}, "none": {"nope": 1.0}}
    got = {r["scenario"]: r for r in scenario.compare_scenarios(one, plans, scorer, ["track_id"]).collect()}
    assert {k: r["rank"] for k, r in got.items()} == {"up": 1, "same": 1, "none": 2, "down": 3}
    assert got["up"]["changes"] == "{'valence': 0.1}"
    default = scenario.compare_scenarios(one, None, scorer, ["track_id"])
    assert default.count() == len(scenario.DEFAULT_SCENARIOS)


def test_rows_that_share_a_key_are_ranked_apart(one):
    plans = {"up": {"valence": 0.1}, "down": {"valence": -0.1}}
    got = scenario.compare_scenarios(one.union(one), plans, scorer, ["track_id"]).collect()
    assert sorted((r["scenario"], r["rank"]) for r in got) == [("down", 2)] * 2 + [("up", 1)] * 2
    lost = scenario.compare_scenarios(one.withColumn("valence", F.lit(None).cast("double")), plans, scorer, ["track_id"]).collect()
    assert [r["rank"] for r in lost] == [1, 1]


def test_single_row_check(one):
    scenario.validate_single(one)
    with pytest.raises(ValueError, match="no row"):
        scenario.validate_single(one.limit(0))
    with pytest.raises(ValueError, match="single row"):
        scenario.validate_single(one.union(one))


def test_model_scenarios(songs):
    got = runs.impact_run(songs, None, {"up": {"energy": 0.5}}, numTrees=3, maxDepth=3)
    assert got.count() > 0 and set(got.select("rank").distinct().toPandas()["rank"]) == {1}
    with pytest.raises(ValueError, match="test row"):
        nobody = songs.sparkSession.createDataFrame([("x",)], "track_id string")
        runs.impact_run(songs, nobody, numTrees=2, maxDepth=2)


# chart tables -------------------------------------------------------------------------------


def test_histogram(tracks):
    df = tracks(*[{"popularity": v} for v in (0, 1, 2, 3, 4)])
    got = [r["row_count"] for r in chartdata.histogram(df, bins=4).collect()]
    assert got == [1, 1, 1, 2]
    same = chartdata.histogram(tracks({}), bins=2).collect()
    assert [r["row_count"] for r in same] == [0, 1] and same[0]["bin_low"] == 47.5


def test_charts_of_categories(songs):
    assert chartdata.top_categories(songs, 2).count() == 2
    means = chartdata.category_targets(songs, 3).collect()
    assert [r["category"] for r in means] == ["ska", "dub", "fado"]
    boxes = {r["category"]: r for r in chartdata.boxes(songs, "tempo", 3).collect()}
    assert boxes["ska"]["q1"] <= boxes["ska"]["median"] <= boxes["ska"]["q3"]
    dense = chartdata.violin_density(songs, "tempo", 3, 4)
    assert dense.groupBy("category").agg(F.sum("share").alias("s")).filter("abs(s - 1) > 1e-9").isEmpty()
    assert chartdata.violins(songs, "tempo", 2).count() == 2


def test_box_whiskers(tracks):
    df = tracks(*[{"tempo": v} for v in (100, 101, 102, 103, 500)])
    got = chartdata.boxes(df, "tempo").first()
    assert (got["whisker_low"], got["whisker_high"], got["outliers"]) == (100, 103, 1)


def test_correlation_charts(songs, tracks):
    bars = {r["feature"]: r for r in chartdata.correlation_bars(tracks({})).collect()}
    assert bars["energy"]["r"] == 0.0
    forest = chartdata.correlation_forest(songs, n_bootstrap=50).collect()
    assert all(r["arm_low"] >= 0 and r["arm_high"] >= 0 for r in forest)
    assert chartdata.heatmap(songs).count() == 81
    hits = {r["feature"]: r for r in chartdata.hit_profiles_scaled(songs, 50).collect()}
    assert hits["energy"]["hit_mean"] > hits["energy"]["non_hit_mean"]
    assert hits["loudness"]["hit_mean"] == -8.25


def test_scatter_is_an_exact_sample(songs):
    a = chartdata.scatter(songs.repartition(1), sample=10).collect()
    b = chartdata.scatter(songs.repartition(6), sample=10).collect()
    assert a == b and len(a) == 10
    assert chartdata.scatter(songs, sample=1000).count() == 3 * EACH


def test_prediction_chart(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 2.0, 2.0), (3.0, 3.0, None)], "y double, a double, b double")
    got = {r["model"]: r for r in chartdata.actual_vs_predicted(df, "y", ["a", "b"]).collect()}
    assert got["a"]["r2"] == 1.0 and got["b"]["r2"] == -1.0 and got["a"]["row_count"] == 2
    assert chartdata.importance_bars(spark.createDataFrame([("a", 0.2), ("b", 0.8)], "feature string, importance double"), 1).first()["feature"] == "b"


def test_score_labels(spark):
    df = spark.createDataFrame([(" x ", None, 0.5)], "track_name string, artists string, preference_score double")
    assert chartdata.score_bars(df).first()["label"] == "x  —  "


# sources and sinks --------------------------------------------------------------------------------


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(',track_name,popularity,explicit,note\n0,"a ""b"", \nc",7,True,NA\n1,d,x,no,keep\n')
    rows = io.load_csv(spark, str(path), multiline=True).orderBy("track_name").collect()
    assert rows[0].asDict() == {"track_name": 'a "b", \nc', "popularity": 7.0, "explicit": True, "note": None}
    assert rows[1]["popularity"] is None and rows[1]["explicit"] is False and rows[1]["note"] == "keep"
    raw = io.load_csv(spark, str(path), typed=False, multiline=True)
    assert {r["popularity"] for r in raw.collect()} == {"7", "x"}


def test_first_row_read_wins(spark, tmp_path):
    from facetra.operators import recommend

    for name, rows in (("a", "t1,z,o\nt2,y,o\nt1,a,o\n"), ("b", "t2,b,o\nt3,c,o\n")):
        (tmp_path / f"{name}.csv").write_text("track_id,track_name,artists\n" + rows)
    spec = TRACKS.with_roles(order_by="read", features=(), numeric=())
    rows = io.load_csv(spark, str(tmp_path), spec, order="read")
    got = rows.orderBy("read").collect()
    assert [(r["track_id"], r["track_name"]) for r in got] == [("t1", "z"), ("t2", "y"), ("t1", "a"), ("t2", "b"), ("t3", "c")]
    first = {r["track_id"]: r["track_name"] for r in recommend.catalogue(rows, spec).collect()}
    assert first == {"t1": "z", "t2": "y", "t3": "c"}


def test_json(spark, tmp_path):
    records = [{"track_id": "a", "popularity": 1, "Unnamed: 0": 0}, {"track_id": "b", "popularity": None}]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(records))
    got = io.load_json(spark, str(path))
    assert "Unnamed: 0" not in got.columns and got.count() == 2
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps(r) for r in records))
    assert io.load_json(spark, str(lines), lines=True).count() == 2


def test_names_and_aliases(spark):
    df = io.normalize_names(spark.createDataFrame([(1, 2)], [" Genre ", "X"]))
    assert df.columns == ["genre", "x"] and TRACKS.resolve_category(df) == "genre"
    assert TRACKS.resolve_category(df.drop("genre")) is None


def test_writing_skips_empty_tables(spark, songs, tmp_path):
    out = io.write_tables({"a": songs, "b": songs.limit(0), "c": None}, str(tmp_path), "parquet")
    assert list(out) == ["a"] and spark.read.parquet(out["a"]).count() == 3 * EACH + 1
    written = runs.export_summary(songs, str(tmp_path))
    assert len(written) == 4


def test_liked_file(spark, tmp_path):
    ids = spark.createDataFrame([("b",), ("a",), ("b",)], "track_id string")
    path = io.save_liked(ids, str(tmp_path / "liked"))
    assert sorted(r[0] for r in io.load_liked(spark, path).collect()) == ["a", "b"]
    array = tmp_path / "array.json"
    array.write_text('[\n "t1",\n "t3"\n]')
    assert sorted(r[0] for r in io.load_liked(spark, str(array)).collect()) == ["t1", "t3"]
    with pytest.raises(FileNotFoundError):
        io.load_liked(spark, str(tmp_path / "none"))
    for bad in ('{"x": 1}', "[oops", "nonsense", ""):
        array.write_text(bad)
        with pytest.raises(ValueError):
            io.load_liked(spark, str(array))


def test_cleaning_run_from_csv(spark, raw_tracks, tmp_path):
    path = str(tmp_path / "raw")
    raw_tracks({"tempo": "fast"}, {"track_id": "t2"}).write.option("header", True).csv(path)
    cleaned, report = runs.run_cleaning(spark, path)
    assert cleaned.count() == 1
    got = {(r["section"], r["column"]): r["value"] for r in report.collect()}
    assert got["numeric_values_coerced_to_missing", "tempo"] == 1
    _, checks = runs.run_validation(spark, path)
    assert checks["report"].count() > 20


def test_stream_cleaning(spark, raw_tracks, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = raw_tracks({"track_id": " a "}, {"tempo": "0"}, {"artists": " "})
    df.write.json(source)
    stream = spark.readStream.schema(df.schema).json(source)
    clean_stream(stream, out, str(tmp_path / "state")).awaitTermination(60)
    got = spark.read.parquet(out).collect()
    assert [r["track_id"] for r in got] == ["a"]
    assert clean.clean_rows(df).count() == 1


# joins ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_lookup_equals_broadcast(spark, how):
    big = spark.range(100).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(k, k * 10) for k in range(5)], "k long, v long")
    a = {tuple(r) for r in lookup_join(big, small, ["k"], how).collect()}
    b = {tuple(r) for r in lookup_join(big, small, ["k"], how, max_rows=2).collect()}
    assert a == b
    assert small_copy(small, 4) is None and small_copy(small, 5).count() == 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(tracks, spark, tmp_path):
    path = str(tmp_path / "t")
    tracks({}, {"track_id": "b"}).write.parquet(path)
    df = spark.read.parquet(path)
    from facetra.operators import analyze

    text = plan(analyze.outliers(df))
    assert "BroadcastHashJoin" in text and "TakeOrderedAndProject" in text
    assert "Exchange hashpartitioning" not in text and "Python" not in text
    read = text.split("ReadSchema: ")[1]
    assert "album_name" not in read and "duration_ms" not in read
    text = plan(analyze.correlations(df))
    assert text.count("FileScan") == 1 and "Join" not in text
    text = plan(clean.clean_data(df))
    assert "Window" not in text
