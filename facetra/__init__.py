"""Spark-native analytics for wide tables of entities with numeric features."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .operators.analyze import run_analysis
from .operators.clean import clean_data, clean_report
from .operators.profile import summarize
from .operators.recommend import recommend
from .operators.validate import validation_report
from .plans.runs import (
    popularity_models,
    run_cleaning,
    run_summary,
    run_validation,
)
from .spec import TRACKS, FeatureSpec

__all__ = [
    "TRACKS",
    "FeatureSpec",
    "clean_data",
    "clean_report",
    "popularity_models",
    "recommend",
    "run_analysis",
    "run_cleaning",
    "run_summary",
    "run_validation",
    "summarize",
    "validation_report",
]
