"""Counts and base scores against plain arithmetic; the model against the base."""

import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetra.llm import maxent

SHAPE = "doc_id long, text string, score double"


def base(rows, held):
    counts = Counter()
    for k, t in rows:
        if not held(k):
            counts.update([w.lower() for w in (t or "").encode().split()] + ["END"])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for k, t in rows:
        words = [w.lower() for w in (t or "").encode().split()] + ["END"]
        out[k] = (len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    return out


@pytest.mark.parametrize("head", [3, 200_000])
def test_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(maxent, "HEAD", head)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.3, 60))) for i in range(60)] + [(98, ""), (99, None), (97, "É é A " * 3000)]
    docs = spark.createDataFrame([(*r, None) for r in rows], SHAPE).repartition(3)
    got = maxent.score_texts(docs, F.col("doc_id") % 5 == 2).collect()
    want = base(rows, lambda k: k % 5 == 2)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == (r.doc_id % 5 == 2)
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)


def test_probabilities_sum_to_at_most_one(spark):
    texts = ["a b c a b", "b b a", "zz yy a b"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SHAPE)
    counts = maxent.counted_tokens(docs.select(F.col("text").cast("binary").alias("data")))
    v = maxent.vocabulary(counts, len(texts))
    table = maxent.train(docs.select(F.col("text").cast("binary").alias("data")), v)
    t = maxent.numbered([b"a b zz"], v)
    every = sum(np.exp(maxent.class_logs(table, replace(t, classes=np.full(len(t.classes), k)))) for k in range(maxent.CLASSES))
    assert np.allclose(every, 1, atol=1e-5)
    seen = {bytes(r.token): r.n for r in counts.collect()}
    by_class: dict[int, float] = {}
    for w, c in seen.items():
        k = v.classes[v.head[w]]
        by_class[k] = by_class.get(k, 0) + 10 ** (math.log10(c + 1) + v.within()[k])
    assert all(p <= 1 + 1e-9 for p in by_class.values())


def test_context_helps_on_held_out_texts(spark):
    rng = np.random.default_rng(2)
    sets = [[f"{a}{i}{e}" for i in range(40)] for a, e in (("k", "ung"), ("v", "eau"))]
    rows = [(i, " ".join(rng.choice(sets[i % 2], 80)), None) for i in range(300)]
    got = maxent.score_texts(spark.createDataFrame(rows, SHAPE).repartition(2), F.col("doc_id") % 7 == 2).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.2 * held.n_tokens.sum()


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(None, "a b", None), (None, "a b", None)], SHAPE)
    assert maxent.score_texts(docs.limit(0), F.lit(False)).count() == 0
    got = maxent.score_texts(docs, F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] * 2
    assert all(r.held_out is False for r in maxent.score_texts(docs, F.col("doc_id") == 1).collect())


def chances(spark, monkeypatch, texts):
    """Tokens of the first text with the probability of their class, after gradient steps over all texts."""
    monkeypatch.setattr(maxent, "TILE", 256)
    rows = spark.createDataFrame([(t,) for t in texts], "data string").select(F.col("data").cast("binary").alias("data"))
    v = maxent.vocabulary(maxent.counted_tokens(rows), len(texts))
    table = maxent.first_table(v)
    squares, used = np.ones_like(table), np.zeros(len(table), np.int64)
    for t in texts:
        maxent.descend(table, squares, used, maxent.numbered([t.encode()], v))
    return zip(texts[0].split(), np.exp(maxent.class_logs(table, maxent.numbered([texts[0].encode()], v))))


@pytest.mark.parametrize("head", [10, 200_000])
def test_every_context_word_is_a_feature_of_its_own(spark, monkeypatch, head):
    # which word comes after a name follows from the name; all names have one ending, and are equally rare
    monkeypatch.setattr(maxent, "HEAD", head)
    rng = np.random.default_rng(3)
    after = rng.integers(0, 2, 6_000).tolist()
    lines = [" ".join(f"w{i}ing {('left', 'right')[after[i]]}" for i in rng.permutation(6_000)) for _ in range(4)]
    found = [p for w, p in chances(spark, monkeypatch, lines) if w in ("left", "right")]
    assert len(found) == 6_000 and np.quantile(found, 0.2) > 0.6


def test_word_pairs_are_features(spark, monkeypatch):
    # the third word follows from the first two together, not from either; all names have one ending
    rng = np.random.default_rng(4)
    names = [f"n{i}al" for i in range(12)]
    more = " ".join(f"common{i % 20} " for i in range(30_000))  # takes the classes of single words
    pairs = rng.integers(0, 12, (4_000, 2)).tolist()
    line = " ".join(f"{names[a]} {names[b]} {('here', 'there')[(a + b) % 2]}" for a, b in pairs)
    found = [p for w, p in chances(spark, monkeypatch, [line, line, more]) if w in ("here", "there")]
    assert len(found) == 4_000 and np.quantile(found, 0.2) > 0.6


def test_tiles_sum_their_errors_by_row():
    rng = np.random.default_rng(5)
    rows = np.minimum(rng.zipf(1.3, (3_000, maxent.FEATURES + 1)), 60_000).astype(np.uint16)
    error = rng.normal(size=(3_000, maxent.CLASSES)).astype(np.float32)
    own, grad, size = maxent._gradients(error, rows, maxent.Scratch())
    want = np.zeros((1 << 16, maxent.CLASSES))
    np.add.at(want, rows[:, 1:].reshape(-1), np.repeat(error, maxent.FEATURES, axis=0))
    counts = np.bincount(rows[:, 1:].reshape(-1), minlength=1 << 16)
    assert sorted(own.tolist()) == np.flatnonzero(counts).tolist() and (counts[own] == size).all()
    assert np.allclose(grad, want[own], atol=1e-2)
