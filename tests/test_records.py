"""Records across splits against the reader that takes a file as a whole."""

import csv
import random

import pytest

from facetra.sources.records import csv_records, split_csv
from facetra.sources.tables import load_csv


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(n)) for k in before]
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def whole(spark, path):
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [64, 333, 10_000_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_whole_files(spark, tmp_path, small_splits, size, end):
    rng = random.Random(size)
    texts = ["plain", 'say "hi"', "two\nlines", 'a\n\n"b",\nc', "", ",", "é\nñ", '"', "x" * 200, "\n" * 5]
    for name in ("a.csv", "b.csv"):
        rows = [["id", "text", "other name"]] + [[i, rng.choice(texts), rng.choice(texts)] for i in range(60)]
        write(tmp_path / name, rows, end)
    small_splits(size)
    got = split_csv(spark, str(tmp_path))
    assert got.columns == ["id", "text", "other name", "_place"]
    assert sorted(map(str, got.drop("_place").collect())) == whole(spark, str(tmp_path))
    if size == 64:
        assert csv_records(spark, str(tmp_path)).select("file", "block").distinct().count() > 20
    ordered = [r.id for r in got.filter("_place like '%a.csv%'").orderBy("_place").collect()]
    assert ordered == [str(i) for i in range(60)]


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", [["id", "text"], [1, "line\n" * 500], [2, "b"], [3, "c\n" * 90]])
    small_splits(100)
    rows = {r.id: r.text for r in split_csv(spark, str(tmp_path)).collect()}
    assert rows == {"1": "line\n" * 500, "2": "b", "3": "c\n" * 90}


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n\n1,a\n2\n3,"open\nto the end', encoding="utf-8")
    rows = [(r.id, r.text) for r in split_csv(spark, str(tmp_path)).orderBy("_place").collect()]
    assert rows[:2] == [("1", "a"), ("2", None)] and len(rows) == 3
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text("id,text\n", encoding="utf-8")
    assert split_csv(spark, str(tmp_path / "b")).count() == 0


def test_loader_takes_it(spark, tmp_path, small_splits):
    write(tmp_path / "t.csv", [["Unnamed: 0", "track_id", "track_name", "energy"], [0, "a", "two\nlines", "0.5"], [1, "b", "null", "x"]])
    small_splits(40)
    rows = load_csv(spark, str(tmp_path), multiline="split", order="seen").orderBy("seen").collect()
    assert [(r.track_id, r.track_name, r.energy) for r in rows] == [("a", "two\nlines", 0.5), ("b", None, None)]
