"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads. Each query runs
once to warm up, then BENCH_RUNS times; the median counts. Results are computed
in full into Spark's no-op sink, as the operators return them: rounding to compare
them with SQL is left out.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from facetra.plans import catalog, registry  # noqa: E402
from facetra.plans.bindings import Tables  # noqa: E402

HEADLINE = [
    "src1_csv_roundtrip",
    "cln7_dedup_best_row",
    "cln8_clean_table",
    "cln8_clean_report",
    "val4_duplicates",
    "val5_inconsistent_keys",
    "val8_validation_report",
    "sum2_describe_numeric",
    "sum3_describe_categorical",
    "sum5_iqr_outliers",
    "sum6_correlation_matrix",
    "sum8_category_summary",
    "sum9_tier_pivot",
    "ana1_enrich_with_group_stats",
    "ana2_group_deviations",
    "ana3_group_outliers",
    "ana4_item_correlations",
    "ana5_correlation_inference",
    "ana8_feature_buckets",
    "prf12_recommend_cosine",
    "prf12_recommend_euclidean_weighted",
    "prf14_explain",
    "mdl4_impute_from_train",
    "mdl8_hash_split",
    "mdl9_stratified_split",
    "mdl17_linear_fit",
    "mdl18_forest_10_trees",
    "mdl30_class_metrics",
    "mdl39_threshold_curve",
    "clu3_assigned_clusters",
    "clu7_silhouette",
    "imp5_compare_scenarios",
    "viz2_histogram",
    "viz12_boxes",
]


def main() -> None:
    missing = set(HEADLINE) - set(catalog.QUERIES)
    assert not missing, missing
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in os.environ.get("BENCH_QUERIES", "").split() or HEADLINE:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            registry.PLAIN[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        took[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", folder)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": float(scale.group(1)) if scale else None,
    }
    print(json.dumps(result))
    spark.stop()


main()
