import math
import statistics

import numpy as np
import pytest
from conftest import as_dict

from facetra.functions.quantiles import quantiles
from facetra.operators import profile

COLUMNS = ("popularity", "danceability", "energy", "track_genre", "artists")
VALUES = [(10, 0.1, 0.5, "dub", "K"), (33, 0.2, 0.4, "ska", "L"), (58, 0.5, 0.6, "soul", "K"), (76, 0.7, 0.3, "funk", "M"), (91, 0.6, 0.5, "ska", "N")]
ROWS = [{"track_id": str(i), **dict(zip(COLUMNS, v))} for i, v in enumerate(VALUES)]


@pytest.fixture
def df(tracks):
    return tracks(*ROWS)


def test_shape(df):
    got = as_dict(profile.describe_shape(df), "section", "column")
    assert got["rows", "total"] == 5 and got["columns", "total"] == 20
    assert got["dtype", "double"] == 14 and got["dtype", "string"] == 5


def test_numeric(df):
    got = {r["column"]: r for r in profile.describe_numeric(df).collect()}
    pop = got["popularity"]
    assert pop["count"] == 5 and pop["mean"] == 53.6 and pop["median"] == 58.0
    assert pop["std"] == pytest.approx(statistics.stdev([v[0] for v in VALUES]))
    assert pop["q1"] == 33.0 and pop["q3"] == 76.0
    assert got["tempo"]["skewness"] == 0.0 and got["tempo"]["kurtosis"] == 0.0


def test_bias_corrected_moments(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "popularity double")
    got = profile.describe_numeric(df).first()
    assert got["skewness"] == pytest.approx(1.3309, abs=1e-4)
    assert got["kurtosis"] == pytest.approx(1.5, abs=1e-9)


def test_all_null_column_is_left_out(tracks):
    got = {r["column"] for r in profile.describe_numeric(tracks({"tempo": None})).collect()}
    assert "tempo" not in got and "energy" in got


def test_categorical(df):
    rows = profile.describe_categorical(df, top_n=2).collect()
    genre = [(r["rank"], r["value"], r["count"], r["num_unique"]) for r in rows if r["column"] == "track_genre"]
    assert sorted(genre) == [(1, "ska", 2, 4), (2, "dub", 1, 4)]


def test_column_without_values_stays(tracks):
    rows = profile.describe_categorical(tracks({"artists": None}, {"artists": None}), top_n=2).collect()
    assert [(r["num_unique"], r["rank"], r["value"]) for r in rows if r["column"] == "artists"] == [(0, None, None)]


def test_missing(tracks):
    got = {r["column"]: r for r in profile.describe_missing(tracks({"tempo": None}, {}, {})).collect()}
    assert got["tempo"]["count"] == 1 and got["tempo"]["percentage"] == 33.33
    empty = {r["column"]: r for r in profile.describe_missing(tracks({}).limit(0)).collect()}
    assert empty["tempo"]["count"] == 0 and empty["tempo"]["percentage"] == 0.0


def test_outliers(tracks):
    df = tracks(*[{"tempo": v} for v in (100, 101, 102, 103, 500)])
    got = {r["column"]: r for r in profile.detect_outliers(df).collect()}["tempo"]
    assert got["count"] == 1 and got["percentage"] == 20.0
    assert (got["lower_bound"], got["upper_bound"]) == (98.0, 106.0)


def test_matrix(tracks):
    df = tracks(*[{"energy": e, "valence": 1 - e} for e in (0.1, 0.5, 0.7)])
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.correlation_matrix(df).collect()}
    assert len(got) == 100 and got["energy", "valence"] == pytest.approx(-1)
    assert got["energy", "energy"] == 1.0 and got["tempo", "energy"] is None


def test_target_correlations(df):
    got = [(r["feature"], r["correlation"]) for r in profile.target_correlations(df).collect()]
    assert [f for f, _ in got] == ["danceability", "energy"]
    assert all(abs(a[1]) >= abs(b[1]) for a, b in zip(got, got[1:]))
    with pytest.warns(UserWarning, match="not found"):
        assert profile.target_correlations(df, "nope").isEmpty()


def test_category_summary(df):
    got = {r["track_genre"]: r for r in profile.category_summary(df).collect()}
    assert got["ska"]["danceability_count"] == 2
    assert got["ska"]["danceability_mean"] == pytest.approx(0.4)
    assert got["dub"]["danceability_std"] is None


def test_tiers(df):
    got = {r["track_genre"]: r.asDict() for r in profile.tier_pivot(df).collect()}
    assert got["dub"]["Low"] == 1 and got["ska"]["Medium"] == 1
    assert got["ska"]["Very High"] == 1 and got["soul"]["High"] == 1 and got["soul"]["Low"] == 0


def test_tier_edges(tracks):
    df = tracks(*[{"popularity": v} for v in (0, 25, 26, 100, 101)], {"popularity": None})
    got = profile.tier_pivot(df).first()
    assert (got["Low"], got["Medium"], got["High"], got["Very High"]) == (2, 1, 0, 1)


def test_summary_parts(df):
    assert set(profile.summarize(df)) == {
        "shape",
        "numeric",
        "categorical",
        "missing",
        "outliers",
        "correlation_matrix",
        "target_correlations",
        "category_summary",
        "tier_pivot",
    }


@pytest.mark.parametrize("shape", ["uniform", "heavy", "ties", "far"])
def test_narrowed_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(3)
    n = 3000
    values = {
        "uniform": rng.random(n),
        "heavy": np.exp(rng.normal(0, 8, n)),
        "ties": np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 10, n)).astype(float),
        "far": np.concatenate([rng.normal(0, 1e-3, n - 2), [1e308, -1e308]]),
    }[shape]
    groups = ["a" if i % 3 else "b" for i in range(n)]
    rows = [(g, float(v)) for g, v in zip(groups, values)] + [("a", None), ("b", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = quantiles(df, ["v"], probs, ["g"], direct_values=0, bins=16, leaf_rows=20)
    got = {r["g"]: r["q"] for r in got.collect()}
    for g in "ab":
        own = [v for x, v in zip(groups, values) if x == g]
        assert got[g] == pytest.approx(list(np.quantile(own, probs)), rel=1e-12)


def test_direct_and_narrowed_agree(tracks):
    df = tracks(*[{"tempo": 100 + i, "energy": (i * 7 % 11) / 11} for i in range(30)])
    a = {r["column"]: r["q"] for r in quantiles(df, ["tempo", "energy"], (0.1, 0.5)).collect()}
    b = {
        r["column"]: r["q"]
        for r in quantiles(df, ["tempo", "energy"], (0.1, 0.5), direct_values=0, bins=4, leaf_rows=3).collect()
    }
    assert a.keys() == b.keys() and all(a[c] == pytest.approx(b[c]) for c in a)


def test_many_groups_go_through_the_shared_folder(spark, monkeypatch):
    """The search with a state too large for the driver gives the same."""
    from facetra.functions import quantiles as q

    rows = [(i % 4, float(i * i % 97)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v double")
    narrow = {"direct_values": 0, "bins": 8, "leaf_rows": 10}
    want = {r["g"]: r["q"] for r in quantiles(df, ["v"], (0.3, 0.5), ["g"], **narrow).collect()}
    monkeypatch.setattr(q, "small_table", lambda *_: None)
    monkeypatch.setattr(q, "small_copy", lambda *_: None)
    got = {r["g"]: r["q"] for r in quantiles(df, ["v"], (0.3, 0.5), ["g"], **narrow).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
