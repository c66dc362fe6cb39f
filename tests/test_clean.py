import pytest
from conftest import as_dict

from facetra.operators import clean
from facetra.spec import TRACKS


def test_missing_columns_are_named(raw_tracks):
    df = raw_tracks({}).drop("tempo", "track_name")
    with pytest.raises(ValueError, match="tempo, track_name"):
        clean.validate_cleaning_columns(df)


def test_index_column_is_dropped(raw_tracks):
    df, n = clean.drop_index_column(raw_tracks({"Unnamed: 0": 7}))
    assert n == 1 and "Unnamed: 0" not in df.columns
    assert clean.drop_index_column(df)[1] == 0


def test_text_is_stripped_and_blank_is_null(raw_tracks):
    df = raw_tracks({"artists": "  Someone Else\t", "album_name": "   ", "track_name": " x "})
    got = clean.standardize_text(df).first()
    assert got["artists"] == "Someone Else" and got["album_name"] is None and got["track_name"] == "x"
    counts = as_dict(clean.blank_counts(df))
    assert counts["album_name"] == 1 and counts["artists"] == 0


def test_flag_spellings(raw_tracks):
    df = raw_tracks({"explicit": "TRUE"}, {"explicit": " no "}, {"explicit": "maybe"}, {"explicit": None}, {"explicit": 1})
    got = [r["explicit"] for r in clean.normalize_flag(df).collect()]
    assert got == [True, False, None, None, True]
    assert clean.flag_coercions(df).first()["value"] == 1


def test_numeric_and_boolean_flags(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (2.0,)], "explicit double")
    assert [r[0] for r in clean.normalize_flag(df).collect()] == [True, False, None]
    df = spark.createDataFrame([(True,), (None,)], "explicit boolean")
    assert [r[0] for r in clean.normalize_flag(df).collect()] == [True, None]


@pytest.mark.parametrize(
    "text, value",
    [("fast", None), ("1d", None), (" 2 ", 2.0), (".5", 0.5), ("1.", 1.0), ("1e3", 1000.0), ("nan", None), ("", None), ("-7", -7.0), ("inf", float("inf"))],
)
def test_numeric_text(raw_tracks, text, value):
    df = clean.coerce_numeric(raw_tracks({"tempo": text}))
    assert df.first()["tempo"] == value


def test_numeric_coercions_are_counted(raw_tracks):
    df = raw_tracks({"tempo": "fast", "popularity": "very popular"}, {"tempo": None})
    counts = as_dict(clean.numeric_coercions(df))
    assert counts["tempo"] == 1 and counts["popularity"] == 1 and counts["energy"] == 0


def test_required_text(tracks):
    df = tracks({}, {"track_name": None}, {"artists": None})
    assert clean.drop_missing(df).count() == 1
    counts = as_dict(clean.missing_counts(df))
    assert counts == {"track_id": 0, "artists": 1, "track_name": 1, "track_genre": 0}


def test_invalid_values(tracks):
    df = tracks({"danceability": 1.5}, {"tempo": 0}, {"duration_ms": -10}, {"popularity": 120})
    kept = clean.remove_invalid(df).collect()
    assert len(kept) == 1 and kept[0]["popularity"] is None
    counts = as_dict(clean.invalid_counts(df))
    assert (counts["danceability"], counts["tempo"], counts["duration_ms"], counts["popularity"]) == (1, 1, 1, 1)


def test_bounds_are_inclusive(tracks):
    df = tracks({"danceability": 0, "energy": 1, "popularity": 100})
    assert clean.remove_invalid(df).count() == 1


def test_dedup_keeps_higher_target(tracks):
    df = tracks({"popularity": 10}, {"popularity": 50})
    got = clean.deduplicate(df).collect()
    assert len(got) == 1 and got[0]["popularity"] == 50


def test_dedup_prefers_complete_rows(tracks):
    df = tracks({"popularity": 90, "album_name": None, "loudness": None}, {"popularity": 10})
    assert clean.deduplicate(df).first()["popularity"] == 10


def test_dedup_uses_ingest_order(tracks, spark):
    from pyspark.sql import functions as F

    df = tracks({"album_name": "b"}, {"album_name": "a"}).withColumn(
        "line", F.when(F.col("album_name") == "b", 0).otherwise(1)
    )
    kept = clean.deduplicate(df, TRACKS.with_roles(order_by="line")).first()
    assert kept["album_name"] == "b"


def test_duplicate_counts(tracks):
    df = tracks({}, {}, {"popularity": 1}, {"track_id": "t2"})
    got = clean.duplicate_counts(df).first()
    assert (got["rows"], got["distinct_rows"], got["distinct_keys"]) == (4, 3, 2)


def test_full_cleaning(raw_tracks):
    first = {"Unnamed: 0": 0, "artists": " Someone ", "explicit": "False", "popularity": "80"}
    df = raw_tracks(
        first,
        {**first, "Unnamed: 0": 1, "popularity": "20"},
        {**first, "Unnamed: 0": 2, "track_id": "track-2", "track_name": " "},
        {**first, "Unnamed: 0": 3, "track_id": "track-3", "tempo": "0"},
    )
    rows = clean.clean_data(df).collect()
    assert len(rows) == 1 and rows[0]["track_id"] == "row-1"
    assert rows[0]["explicit"] is False and rows[0]["popularity"] == 80
    report = as_dict(clean.clean_report(df), "section", "column")
    assert report["input_rows", "total"] == 4
    assert report["output_rows", "total"] == 1
    assert report["rows_removed_total", "total"] == 3
    assert report["index_columns_removed", "total"] == 1
    assert report["blank_text_values", "track_name"] == 1
    assert report["rows_removed_for_missing_values", "total"] == 1
    assert report["rows_removed_for_invalid_values", "total"] == 1
    assert report["rows_removed_for_duplicates", "total"] == 1
    assert report["duplicate_rows_removed", "total"] == 0
    assert report["duplicate_keys_removed", "total"] == 1
    assert report["invalid_values_detected", "tempo"] == 1


def test_cleaning_is_partition_invariant(tracks):
    rows = [{"track_id": f"t{i % 5}", "popularity": i % 3, "energy": (i % 7) / 10} for i in range(40)]
    df = tracks(*rows)
    one = {tuple(r) for r in clean.clean_data(df.repartition(1)).collect()}
    many = {tuple(r) for r in clean.clean_data(df.repartition(7)).collect()}
    assert one == many and len(one) == 5
