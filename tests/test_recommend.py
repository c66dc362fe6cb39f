import numpy as np
import pytest

from facetra.operators import recommend as rec
from facetra.spec import TRACKS

FS = list(TRACKS.features)


@pytest.fixture
def items(tracks):
    rows = [("t1", 0.15, 0.85, 172), ("t2", 0.62, 0.2, 88), ("t3", 0.4, 0.45, 104), ("t4", 0.88, 0.7, 126), ("t5", 0.33, 0.1, 95)]
    return tracks(
        *[
            {"track_id": k, "track_name": f"Song {k}", "artists": f"Artist (A.{k})", "danceability": d, "energy": e, "tempo": t}
            for k, d, e, t in rows
        ]
    )


@pytest.fixture
def liked(items):
    return lambda *ids: rec.add_ids(None, items, list(ids))


def ids(df):
    return [r["track_id"] for r in df.collect()]


def test_catalogue_has_one_row_per_key(items):
    assert rec.catalogue(items.union(items.limit(2))).count() == 5
    with pytest.raises(ValueError, match="energy"):
        rec.catalogue(items.drop("energy"))


def test_liked_set(items, liked):
    with pytest.raises(ValueError, match="2 ids are not in"):
        liked("nope", "t1", "no")
    some = rec.add_by_name(liked("t1"), items, "SONG T2", "(a.T2")
    assert sorted(ids(some)) == ["t1", "t2"]
    with pytest.raises(ValueError, match="Song t2.*by 'x'"):
        rec.add_by_name(some, items, "Song t2", "x")
    assert ids(rec.remove_ids(some, ["t1", "zz"])) == ["t2"]
    assert rec.clear(some).isEmpty()
    shown = rec.show(items, some)
    assert shown.columns == ["track_id", "track_name", "artists", "popularity"] and shown.count() == 2


def test_profile(items, liked):
    got = rec.build_profile(items, liked("t1", "t2")).first()
    assert got["danceability"] == pytest.approx(0.385) and got["tempo"] == 130
    with pytest.raises(ValueError, match="empty"):
        rec.build_profile(items, rec.clear(liked("t1")))


def _reference(items, chosen, method, inverse=False):
    """The scores by plain numpy."""
    rows = items.orderBy("track_id").collect()
    x = np.array([[r[f] for f in FS] for r in rows])
    lo, span = x.min(0), np.ptp(x, 0)
    s = (x - lo) / np.where(span > 0, span, 1)
    mine = s[[r["track_id"] in chosen for r in rows]]
    p = mine.mean(0)
    w = np.full(len(FS), 1 / len(FS))
    if inverse:
        w = 1 / (mine.var(0) + 1e-9)
        w = w / w.sum()
    if method == "euclidean":
        raw = -(w * (s - p) ** 2).sum(1)
    else:
        size = np.linalg.norm(s, axis=1) * np.linalg.norm(p)
        raw = np.where(size > 0, s @ p / np.where(size > 0, size, 1), 0)
    unit = (raw - raw.min()) / (raw.max() - raw.min())
    return {r["track_id"]: (a, b) for r, a, b in zip(rows, raw, unit)}


@pytest.mark.parametrize("method, weights", [("cosine", "uniform"), ("euclidean", "uniform"), ("euclidean", "inverse_variance")])
def test_scores(items, liked, method, weights):
    chosen = liked("t1", "t3")
    taste = rec.learn_taste(items, chosen, weights)
    want = _reference(items, {"t1", "t3"}, method, weights == "inverse_variance")
    for r in rec.score(items, taste, method).collect():
        assert r["raw_score"] == pytest.approx(want[r["track_id"]][0], abs=1e-9)
        assert r["preference_score"] == pytest.approx(want[r["track_id"]][1], abs=1e-4)


def test_recommend(items, liked):
    got = rec.recommend(items, liked("t1"))
    assert got.columns == ["track_id", "track_name", "artists", "track_genre", "popularity", "preference_score"]
    scores = [r["preference_score"] for r in got.collect()]
    assert "t1" not in ids(got) and scores == sorted(scores, reverse=True)
    assert all(0 <= s <= 1 for s in scores)
    first = rec.recommend(items, liked("t1"), top_n=1, exclude_liked=False).collect()
    assert first[0]["track_id"] == "t1" and first[0]["preference_score"] == 1.0
    assert rec.recommend(items, liked("t1"), top_n=2).count() == 2


def test_equal_catalogue_scores_zero(tracks):
    items = tracks(*[{"track_id": f"t{i}", "track_name": f"S{i}"} for i in range(3)])
    got = rec.recommend(items, rec.add_ids(None, items, ["t0"])).collect()
    assert [r["preference_score"] for r in got] == [0.0, 0.0]


def test_deduplication(tracks):
    hit = {"track_name": "Hit", "artists": "Star", "danceability": 0.7}
    items = tracks(
        {"track_id": "t1", "danceability": 0.3},
        {"track_id": "t2a", **hit},
        {"track_id": "t2b", "track_genre": "dance", **hit},
        {"track_id": "t3", "track_name": None},
    )
    mine = rec.add_ids(None, items, ["t1"])
    assert ids(rec.recommend(items, mine)) == ["t2a"]
    assert sorted(ids(rec.recommend(items, mine, deduplicate=False))) == ["t2a", "t2b", "t3"]


def test_unknown_options(items, liked):
    with pytest.raises(ValueError, match="method 'manhattan'"):
        rec.recommend(items, liked("t1"), method="manhattan")
    with pytest.raises(ValueError, match="weights 'tf-idf'"):
        rec.recommend(items, liked("t1"), method="euclidean", weights="tf-idf")
    with pytest.warns(UserWarning, match="at least 2 liked"):
        rec.recommend(items, liked("t1"), method="euclidean", weights="inverse_variance")


def test_explanations(items, liked):
    plain = rec.recommend(items, liked("t1")).collect()
    told = rec.recommend(items, liked("t1"), return_explanations=True).collect()
    assert [r["preference_score"] for r in plain] == [r["preference_score"] for r in told]
    assert len(told[0]["top_matches"].split(", ")) == 3


def test_explain(items, liked):
    mine = liked("t1", "t2")
    rows = rec.explain(items, mine, "t3", "euclidean").collect()
    assert {r["feature"] for r in rows} == set(FS)
    gaps = [r["abs_delta"] for r in rows]
    assert gaps == sorted(gaps) and all(r["attribution"] <= 0 for r in rows)
    raw = _reference(items, {"t1", "t2"}, "euclidean")["t3"][0]
    assert sum(r["attribution"] for r in rows) == pytest.approx(raw, abs=1e-12)
    assert "attribution" not in rec.explain(items, mine, "t3").columns
    with pytest.raises(ValueError, match="not found"):
        rec.explain(items, mine, "nope")


def test_explain_top(items, liked):
    rows = rec.explain_top(items, liked("t1"), "t2", 2).collect()
    best = [r["abs_delta"] for r in rows if r["bucket"] == "matches"]
    worst = [r["abs_delta"] for r in rows if r["bucket"] == "mismatches"]
    assert len(best) == len(worst) == 2 and max(best) <= min(worst)
    with pytest.raises(ValueError, match="n must be"):
        rec.explain_top(items, liked("t1"), "t2", 0)


@pytest.mark.parametrize("method", ["cosine", "euclidean"])
def test_feature_without_values_says_nothing(items, method):
    from pyspark.sql import functions as F

    bare = items.withColumn("valence", F.lit(None).cast("double"))
    mine = rec.add_ids(None, bare, ["t1", "t2"])
    got = rec.recommend(bare, mine, method=method, weights="inverse_variance").collect()
    want = rec.recommend(items.withColumn("valence", F.lit(0.5)), mine, method=method).collect()
    assert len(got) == 3 and all(r["preference_score"] is not None for r in got)
    if method == "cosine":
        assert [r["track_id"] for r in got] == [r["track_id"] for r in want]


def test_seeds(items):
    assert ids(rec.seeds(items, 2)) == ["t1", "t2"]
