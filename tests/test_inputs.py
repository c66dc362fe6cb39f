"""Queries that write or derive their input: many files, and one derivation."""

import pytest

from facetra.plans import checks_tables
from facetra.plans.bindings import Tables


def test_csv_is_written_by_every_task(spark, tmp_path, monkeypatch):
    rows = [(i, f'line {i}\nsays "so", twice' if i % 3 else "", "en", i) for i in range(40)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").repartition(4)
    made.write.parquet(str(tmp_path / "documents.parquet"))
    for c, v in (("spark.sql.files.maxPartitionBytes", "4096"), ("spark.sql.files.openCostInBytes", "4096"), ("spark.sql.files.minPartitionNum", "4")):
        spark.conf.set(c, v)
    try:
        monkeypatch.setattr(checks_tables, "scratch", lambda spark: str(tmp_path / "csv"))
        got = checks_tables._csv_split(Tables(spark, str(tmp_path))).collect()
    finally:
        for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.unset(c)
    assert len(list((tmp_path / "csv").glob("part-*"))) > 1
    assert sorted((r.doc_id, r.text or "", r.lang, r.n_chars) for r in got) == rows


def test_catalogue_is_joined_once(spark, tmp_path, monkeypatch):
    parts = [(i, f"part {i}", f"b{i % 2}", f"t{i % 3}", i, 10.0 + i) for i in range(9)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(i, 1, i % 9, float(i), 100.0 * i, 0.01, 0.02) for i in range(30)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    whole = checks_tables.profile.summarize
    monkeypatch.setattr(checks_tables.profile, "summarize", lambda df, spec: seen.append(df) or whole(df, spec))
    got = {r.name: r.n for r in checks_tables._all(Tables(spark, str(tmp_path))).collect()}
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert got["numeric"] == pytest.approx(8) and len(got) == 9
