"""Sets of centres that move within tasks, and by shared passes where tasks cannot hold the rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from facetra.operators import cluster


@pytest.fixture(scope="module")
def noise(spark):
    """Uniform rows, on which k-means moves for long; some of them twice."""
    x = np.random.default_rng(3).random((600, 3))
    rows = [(row.tolist(),) for row in np.concatenate([x, x[:50]])]
    made = spark.createDataFrame(rows, "x array<double>").select(array_to_vector("x").alias("features"))
    return made.coalesce(2).persist()


def test_moves_cost_no_jobs(spark, noise):
    jobs = []
    for most in (2, 60):
        spark.sparkContext.setJobGroup(f"moves {most}", "")
        cluster.fit_each(noise, [4, 6], restarts=2, max_iter=most)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"moves {most}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 2


def test_tasks_and_passes_agree(noise, monkeypatch):
    held = cluster.fit_each(noise, [2, 3, 5], restarts=3)
    monkeypatch.setattr(cluster, "MAX_TASK_BYTES", 0)
    monkeypatch.setattr(cluster, "STRIP_ROWS", 100)
    passed = cluster.fit_each(noise, [2, 3, 5], restarts=3)
    x = np.array([r[0].toArray() for r in noise.collect()])
    for k, model in held.items():
        assert (model.centres == passed[k].centres).all() and model.cost == passed[k].cost
        gaps = ((x[:, None] - model.centres[None]) ** 2).sum(axis=2)
        assert model.cost == pytest.approx(gaps.min(axis=1).sum())
        nearest = gaps.argmin(axis=1)
        means = np.array([x[nearest == i].mean(axis=0) for i in range(k)])
        assert means == pytest.approx(model.centres, abs=1e-3)
        assert model.transform(noise).groupBy("prediction").agg(F.count("*").alias("n")).count() == k
