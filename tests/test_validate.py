import pytest
from conftest import as_dict

from facetra.operators import validate


def test_schema(tracks, spark):
    with pytest.raises(ValueError, match="energy"):
        validate.validate_schema(tracks({}).drop("energy"))
    with pytest.warns(UserWarning, match="surprise"):
        assert validate.validate_schema(tracks({}).selectExpr("*", "1 AS surprise")) == ["surprise"]


def test_range_counts(tracks):
    df = tracks({"tempo": 0, "danceability": 1.5, "energy": -0.1}, {"duration_ms": 0, "liveness": 1.5}, {"valence": None})
    got = as_dict(validate.range_violations(df))
    assert {c: n for c, n in got.items() if n} == {
        "tempo": 1,
        "danceability": 1,
        "energy": 1,
        "duration_ms": 1,
        "liveness": 1,
    }
    assert got["valence"] == 0
    assert validate.nonzero(validate.range_violations(df)).count() == 5


def test_ranges_raise_with_every_column(tracks):
    validate.validate_ranges(tracks({"danceability": 0, "energy": 1}))
    with pytest.raises(ValueError, match="energy.*tempo"):
        validate.validate_ranges(tracks({"tempo": -1, "energy": 2}))


def test_absent_columns_are_skipped(tracks):
    got = as_dict(validate.range_violations(tracks({"tempo": 0}).drop("energy")))
    assert "energy" not in got and got["tempo"] == 1


def test_duplicates(tracks):
    df = tracks({}, {}, {"track_name": "Other"})
    got = validate.duplicates(df).first()
    assert (got["duplicate_rows"], got["duplicate_keys"]) == (1, 2)


def test_null_keys_are_equal(tracks):
    df = tracks({"track_id": None}, {"track_id": None, "energy": 0.1})
    assert validate.duplicates(df).first()["duplicate_keys"] == 1


def test_consistency(tracks):
    df = tracks(
        {"danceability": 0.4},
        {"danceability": 0.9},
        {"track_id": "t2"},
        {"track_id": "t2", "energy": None},
        {"track_id": None, "energy": 0.1},
        {"track_id": None, "energy": 0.2},
    )
    assert validate.count_inconsistent(df).first()[0] == 1


def test_pair_correlation(tracks):
    rows = [{"energy": e, "loudness": x} for e, x in ((0.1, -3.0), (0.9, -6.0), (0.2, -4.0))]
    got = validate.pair_correlation(tracks(*rows)).first()
    assert got["r"] < 0.5 and got["is_weak"]
    constant = validate.pair_correlation(tracks({}, {})).first()
    assert constant["r"] is None and not constant["is_weak"]


def test_report(tracks):
    df = tracks({"artists": None}, {"track_id": "t2"}, {"track_id": "t2", "track_name": "x"})
    got = as_dict(validate.validation_report(df), "section", "column")
    assert got["num_rows", "total"] == 3 and got["num_columns", "total"] == 20
    assert got["missing_values", "artists"] == 1
    assert got["duplicate_rows", "total"] == 0 and got["duplicate_keys", "total"] == 1
    assert got["unique_keys", "total"] == 2 and got["inconsistent_keys", "total"] == 0


def test_null_key_is_not_unique_key(tracks):
    got = as_dict(validate.validation_report(tracks({"track_id": None}, {})), "section", "column")
    assert got["unique_keys", "total"] == 1
