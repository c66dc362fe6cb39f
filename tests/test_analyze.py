import math

import pytest
from pyspark.sql import functions as F

from facetra.functions.stats import _incomplete_beta, bootstrap_intervals, correlation_p, holm_adjust
from facetra.operators import analyze
from facetra.spec import TRACKS

TARGETS = {"folk": (91, 83, 77, 69), "metal": (52, 44, 47), "swing": (22, 31)}


def made(i, genre, target):
    """A row whose features follow the target, with a small uneven part of their own."""
    own = (i * 37 % 11) / 100
    unit = target / 125
    return {
        "track_id": f"t{i}",
        "track_genre": genre,
        "popularity": target,
        "danceability": unit,
        "energy": unit / 2 + own,
        "loudness": -12 + 7 * unit - own,
        "speechiness": 0.02 + own,
        "acousticness": 0.8 - unit + own,
        "valence": 0.3 + unit / 3 - own,
        "instrumentalness": own * own,
        "liveness": 0.3 - own,
        "tempo": 88 + 31 * unit + 90 * own,
    }


@pytest.fixture
def df(tracks):
    rows = [(g, v) for g, values in TARGETS.items() for v in values]
    return tracks(*[made(i, g, v) for i, (g, v) in enumerate(rows)])


def test_enrich(df):
    rich = analyze.enrich(df)
    assert rich.count() == 9 and set(df.columns) <= set(rich.columns)
    pop = rich.filter("track_genre = 'folk'").select("danceability_group_mean").distinct().collect()
    assert len(pop) == 1 and pop[0][0] == pytest.approx(0.64)


def test_null_category_keeps_its_row(tracks):
    got = analyze.enrich(tracks({"track_genre": None}, {})).filter("track_genre is null").first()
    assert got["energy_group_mean"] is None


def test_salted_join_gives_the_same(df):
    a = {tuple(r) for r in analyze.deviations(df).collect()}
    b = {tuple(r) for r in analyze.deviations(df, max_rows=1).collect()}
    assert a == b


def test_identical_rows_have_no_score(tracks):
    rows = analyze.deviations(tracks({"track_id": "a"}, {"track_id": "b"})).collect()
    assert all(r["deviation_score"] is None for r in rows)


def test_scores_by_hand(tracks):
    df = tracks({"track_id": "a", "energy": 0.1}, {"track_id": "b", "energy": 0.2}, {"track_id": "c", "energy": 0.6})
    got = {r["track_id"]: r for r in analyze.deviations(df).collect()}
    # only energy varies, so it alone gives the score
    assert got["c"]["energy_zscore"] == pytest.approx(1.1339, abs=1e-4)
    assert got["c"]["deviation_score"] == got["c"]["energy_zscore"]


def test_outliers(df):
    got = analyze.outliers(df, threshold=0.0, top_n=3)
    assert got.columns == ["track_id", "track_name", "artists", "track_genre", "popularity", "deviation_score"]
    scores = [r["deviation_score"] for r in got.collect()]
    assert len(scores) == 3 and scores == sorted(scores, reverse=True)
    assert analyze.outliers(df, threshold=5.0).isEmpty()


def test_correlations(df):
    got = analyze.infer_correlations(df, n_bootstrap=200, random_state=0).collect()
    assert {r["feature"] for r in got} == set(TRACKS.features)
    sizes = [r["abs_correlation"] for r in got]
    assert sizes == sorted(sizes, reverse=True) and max(sizes) <= 1
    for r in got:
        assert r["ci_low"] <= r["correlation"] <= r["ci_high"]
        assert (r["direction"] == "positive") == (r["correlation"] > 0)
        assert r["p_value"] <= r["p_value_adjusted"] <= 1
        assert r["significant"] == (r["p_value_adjusted"] < 0.05)
        assert r["n"] == 9


def test_bootstrap_off_and_constant_feature(df):
    got = analyze.infer_correlations(df.withColumn("tempo", F.lit(1.0)), n_bootstrap=0).collect()
    assert len(got) == 8
    assert all(r["ci_low"] is None and r["p_value"] is not None for r in got)


def test_bootstrap_is_deterministic_and_alpha_widens(df):
    def run(data, alpha, seed=7):
        rows = bootstrap_intervals(data, ["energy", "tempo"], "popularity", ["track_id"], 300, alpha, seed)
        return {r["feature"]: (r["ci_low"], r["ci_high"]) for r in rows.collect()}

    one, two = run(df.repartition(1), 0.05), run(df.repartition(5), 0.05)
    for f in one:
        assert one[f] == pytest.approx(two[f])
    wide, narrow = run(df, 0.01), run(df, 0.2)
    assert all(wide[f][1] - wide[f][0] >= narrow[f][1] - narrow[f][0] for f in one)


def test_grouped_bootstrap_matches_theory(spark):
    n = 20_000
    df = spark.range(n).select(
        "id", F.randn(1).alias("x"), (F.randn(2) + 0.3 * F.randn(1)).alias("y")
    )
    r, low, high = None, None, None
    r = df.select(F.corr("x", "y")).first()[0]
    got = bootstrap_intervals(df, ["x"], "y", ["id"], 1000, 0.05, 1, blocks=1000).first()
    low, high = (math.tanh(math.atanh(r) + s * 1.96 / math.sqrt(n - 3)) for s in (-1, 1))
    assert got["ci_low"] == pytest.approx(low, abs=0.003)
    assert got["ci_high"] == pytest.approx(high, abs=0.003)


def test_p_values():
    # t with 1 degree of freedom is Cauchy: p = 1 - 2/pi * atan(t)
    r = 0.6
    t = r / math.sqrt(1 - r * r)
    assert correlation_p(r, 3) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
    # with 2 degrees of freedom p = 1 - |r| for r of 4 pairs
    assert correlation_p(-0.25, 4) == pytest.approx(0.75, abs=1e-12)
    assert correlation_p(1.0, 10) == 0.0 and math.isnan(correlation_p(0.1, 2))
    assert correlation_p(0.001, 9_999_999) == pytest.approx(correlation_p(0.001, 10_000_001), rel=1e-4)
    assert _incomplete_beta(2.0, 3.0, 0.5) == pytest.approx(0.6875)


def test_p_value_matches_linear_regression(df):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=["tempo"], outputCol="features").transform(df)
    fit = LinearRegression(labelCol="popularity", solver="normal").fit(data)
    got = {r["feature"]: r["p_value"] for r in analyze.infer_correlations(df, n_bootstrap=0).collect()}
    assert got["tempo"] == pytest.approx(fit.summary.pValues[0], abs=1e-9)


def _holm(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, p_value double")
    return [r["p_value_adjusted"] for r in holm_adjust(df).orderBy("i").collect()]


def test_holm(spark):
    assert _holm(spark, [0.02, 0.3, 0.011, 0.05]) == pytest.approx([0.06, 0.3, 0.044, 0.1])
    assert _holm(spark, [0.6, 0.7, 0.95]) == pytest.approx([1.0, 1.0, 1.0])
    got = _holm(spark, [0.04, float("nan"), 0.03])
    assert got[1] is None and [got[0], got[2]] == pytest.approx([0.06, 0.06])


def test_compare_categories(df):
    got = {r["category"]: r for r in analyze.compare_categories(df, 3).collect()}
    assert set(got) == {"folk", "metal", "swing"} and got["swing"]["row_count"] == 2
    assert got["folk"]["avg_target"] == 80.0 and got["folk"]["avg_danceability"] == 0.64
    top = analyze.compare_categories(df, 2).collect()
    assert [r["category"] for r in top] == ["folk", "metal"]
    ends = {r["metric"]: r for r in analyze.contrasts(analyze.compare_categories(df)).collect()}
    assert ends["avg_target"]["most"] == "folk" and ends["avg_target"]["least"] == "swing"


def test_buckets(df, tracks):
    got = analyze.feature_buckets(df, "danceability", 3).collect()
    assert len(got) == 3 and sum(r["row_count"] for r in got) == 9
    same = analyze.feature_buckets(df.withColumn("energy", F.lit(0.5)), "energy", 3).collect()
    assert len(same) == 1 and same[0]["row_count"] == 9 and same[0]["avg_target"] == pytest.approx(516 / 9, abs=0.01)
    gap = analyze.feature_buckets(tracks({"tempo": 0}, {"tempo": 10}), "tempo", 5).collect()
    assert [r["row_count"] for r in gap] == [1, 0, 0, 0, 1] and gap[1]["avg_target"] is None
    none = analyze.feature_buckets(df.withColumn("energy", F.lit(None).cast("double")), "energy", 3)
    assert none.isEmpty()
    with pytest.raises(ValueError, match="nope"):
        analyze.feature_buckets(df, "nope")
    with pytest.raises(ValueError, match="n_buckets"):
        analyze.feature_buckets(df, "energy", 0)


def test_bucket_edges_are_right_closed(tracks):
    got = analyze.feature_buckets(tracks(*[{"tempo": v} for v in (0, 1, 2, 3, 4)]), "tempo", 4).collect()
    assert [r["row_count"] for r in got] == [2, 1, 1, 1]


def test_extremes_and_flag(df):
    got = [(r["side"], r["category"]) for r in analyze.category_extremes(df, 1).collect()]
    assert sorted(got) == [("bottom", "swing"), ("top", "folk")]
    assert analyze.flag_means(df).first()["row_count"] == 9


def test_run(df):
    got = analyze.run_analysis(df, n_bootstrap=50)
    assert set(got) == {"correlations", "category_comparison", "outliers", "enriched", "feature_buckets"}
    top = [r["feature"] for r in got["correlations"].take(3)]
    assert list(got["feature_buckets"]) == top
    by = {r["direction"]: r for r in analyze.directions(got["correlations"]).collect()}
    assert "energy" in by["positive"]["features"].split(", ")
