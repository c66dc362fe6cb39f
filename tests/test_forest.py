"""Forests in parts: the same numbers as their trees, saved and read back."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from facetra.operators import models
from facetra.operators.models import Forest


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 3))
    y = x[:, 0] * 2 + x[:, 1]
    data = [(i, *map(float, v), float(t), int(t > 0), "abc"[int(np.searchsorted([-1, 1], t))]) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double, hit int, kind string").coalesce(2).cache()


def test_regression(rows, monkeypatch, tmp_path):
    monkeypatch.setattr(models, "PART_TREES", 4)
    model = models.fit_forest_regressor(rows, "y", [models.assembler(["a", "b", "c"])], numTrees=10, maxDepth=4)
    forest = model.stages[-1]
    assert isinstance(forest, Forest) and [p.getNumTrees for p in forest.parts] == [4, 4, 2]
    assert len({t.toDebugString for t in forest.trees}) == 10  # no two parts share their seed
    out = model.transform(rows)
    assert out.columns == [*rows.columns, "features", "prediction"]
    got = {r.id: r.prediction for r in out.collect()}
    want = {i: 0.0 for i in got}
    for tree in forest.trees:
        for r in tree.transform(out.select("id", "features")).collect():
            want[r.id] += r.prediction / 10
    assert got == pytest.approx(want, abs=1e-12)
    assert sum(forest.featureImportances) == pytest.approx(1.0)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert {r.id: r.prediction for r in back.transform(rows).collect()} == got


def test_classification(rows, monkeypatch, tmp_path):
    monkeypatch.setattr(models, "PART_TREES", 5)
    model = models.fit_forest_classifier(rows, "hit", ["a", "b"], numTrees=12, maxDepth=5)
    scored = models.hit_probability(model, rows)
    assert scored.filter(F.col("score").between(0, 1)).count() == 120
    assert scored.filter((F.col("score") > 0.5) & (F.col("prediction") != 1)).count() == 0
    assert scored.filter((F.col("score") < 0.5) & (F.col("prediction") != 0)).count() == 0
    assert scored.filter("prediction = hit").count() > 110
    model.write().overwrite().save(str(tmp_path / "c"))
    back = models.hit_probability(PipelineModel.load(str(tmp_path / "c")), rows)
    assert {(r.id, r.score) for r in back.collect()} == {(r.id, r.score) for r in scored.collect()}


def test_classes(rows, monkeypatch):
    monkeypatch.setattr(models, "PART_TREES", 3)
    model = models.fit_forest_classes(rows, "kind", ["a", "b"], numTrees=7, maxDepth=5)
    assert isinstance(model.stages[-1], Forest)
    got = models.predict_classes(model, rows, "guess")
    assert got.filter("guess = kind").count() > 100
    assert got.filter(F.abs(F.aggregate("guess_scores", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    assert sum(r.importance for r in models.importances(model, rows).collect()) == pytest.approx(1.0)


def test_grown_over_compact_rows_with_kept_nodes(rows, monkeypatch):
    """Near-empty partitions are put together, and keeping the nodes of rows changes no tree."""
    seen = []
    kept = models.compact
    monkeypatch.setattr(models, "compact", lambda df: seen.append(kept(df)) or seen[-1])
    front = [models.assembler(["a", "b", "c"])]
    settings = {"numTrees": 3, "maxDepth": 12}
    model = models.fit_forest_regressor(rows.repartition(40, "id"), "y", front, **settings).stages[-1]
    assert seen[0].rdd.getNumPartitions() == 1 and model.getCacheNodeIds()
    models.fit_boosted_regressor(rows.repartition(40, "id"), "y", ["a", "b"], "kind", ["id"], maxIter=2, maxDepth=2)
    assert len(seen) == 2 and seen[1].rdd.getNumPartitions() == 1
    fits = [models.fit_forest_regressor(rows.coalesce(1), "y", front, **settings, cacheNodeIds=v).stages[-1] for v in (True, False)]
    assert fits[0].toDebugString.split("\n")[1:] == fits[1].toDebugString.split("\n")[1:]


EXACT = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": 6}


def test_one_tree_is_that_of_mllib(rows):
    """Without draws the tree of arrays cuts as MLlib does, also where leaves are merged or must hold some rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    data = models.assembler(["a", "b", "c"]).transform(rows.withColumn("weight", F.lit(1.0) + F.col("hit")))
    for more in ({}, {"minInstancesPerNode": 4}, {"maxBins": 8}):
        settings = {**EXACT, **more}
        mine = models.fit_forest_regressor(rows, "y", [models.assembler(["a", "b", "c"])], **settings)
        theirs = RandomForestRegressor(labelCol="y", **settings).fit(data)
        got, want = ({r.id: r.prediction for r in m.collect()} for m in (mine.transform(rows), theirs.transform(data)))
        assert got == pytest.approx(want, abs=1e-12)
        assert mine.stages[-1].featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.005)  # equal gains may fall to another feature
        noise = data.withColumn("odd", (F.col("id") % 7 < 3).cast("int"))
        for weight in (None, "weight"):
            mine = models.fit_forest_classifier(noise.drop("features"), "odd", ["a", "b", "c"], weight, **{**settings, "maxDepth": 3})
            one = RandomForestClassifier(labelCol="odd", **{**settings, "maxDepth": 3})
            theirs = (one.setWeightCol(weight) if weight else one).fit(noise)
            got, want = ({r.id: r.score for r in models.hit_probability(m, d).collect()} for m, d in ((mine, noise.drop("features")), (PipelineModel([theirs]), noise)))
            assert got == pytest.approx(want, abs=1e-9)


def test_large_forest_stays_a_table(rows, monkeypatch, tmp_path):
    """A forest beyond what the driver may hold scores by joins, and gives the same as one it holds."""
    from facetra.operators import forest

    front = [models.assembler(["a", "b", "c"])]
    small = models.fit_forest_regressor(rows, "y", front, numTrees=25, maxDepth=8)
    classes = models.fit_forest_classes(rows, "kind", ["a", "b"], numTrees=9, maxDepth=4)
    assert small.stages[-1].held
    monkeypatch.setattr(forest, "MAX_HELD_BYTES", 0)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 7)
    monkeypatch.setattr(forest, "shared_folder", lambda spark: str(tmp_path / "shared"))
    if rows.sparkSession.sparkContext.getCheckpointDir() is None:
        rows.sparkSession.sparkContext.setCheckpointDir(str(tmp_path / "kept"))
    large = models.fit_forest_regressor(rows, "y", front, numTrees=25, maxDepth=8)
    labelled = models.fit_forest_classes(rows, "kind", ["a", "b"], numTrees=9, maxDepth=4)
    assert not large.stages[-1].held and len(large.stages[-1].trees) == 25
    twice = rows.unionByName(rows)
    got, want = ([tuple(r) for r in m.transform(twice).orderBy("id").collect()] for m in (large, small))
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and len(got) == 240
    assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want])
    assert large.stages[-1].featureImportances == small.stages[-1].featureImportances
    got, want = ({r.id: r.guess for r in models.predict_classes(m, rows, "guess").collect()} for m in (labelled, classes))
    assert got == want
    assert large.transform(rows.limit(0)).count() == 0
    large.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert {r.id: r.prediction for r in back.transform(rows).collect()} == {r.id: r.prediction for r in large.transform(rows).collect()}


def test_rows_too_many_for_a_task_go_to_mllib(rows, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressionModel

    from facetra.operators import forest

    monkeypatch.setattr(forest, "MAX_TASK_BYTES", 100)
    monkeypatch.setattr(models, "PART_TREES", 2)
    model = models.fit_forest_regressor(rows, "y", [models.assembler(["a", "b", "c"])], numTrees=4, maxDepth=4)
    assert [type(p) for p in model.stages[-1].parts] == [RandomForestRegressionModel] * 2
    assert model.transform(rows).count() == 120
