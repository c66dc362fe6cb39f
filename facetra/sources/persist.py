"""Saving fitted models with a metadata sidecar, on any Hadoop file system."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

import pyspark
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def metadata_path(path: str) -> str:
    return f"{path.rstrip('/')}.meta.json"


def save_model(
    spark: SparkSession, model: PipelineModel, path: str, metadata: Mapping[str, Any] | None = None
) -> dict[str, str]:
    """Write the model and what is known about it; caller keys win."""
    model.write().overwrite().save(path)
    sidecar = {
        "model_class": type(model).__name__,
        "stages": [type(s).__name__ for s in getattr(model, "stages", [])],
        "spark_version": pyspark.__version__,
        "trained_at_utc": datetime.now(timezone.utc).isoformat(),
        **(metadata or {}),
    }
    text = json.dumps(sidecar, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        metadata_path(path)
    )
    return {"model": path, "metadata": metadata_path(path)}


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict | None]:
    """The model and its metadata; metadata is None without a sidecar."""
    model = PipelineModel.load(path)
    try:
        row = spark.read.text(metadata_path(path)).first()
    except AnalysisException:
        return model, None
    return model, json.loads(row[0])
