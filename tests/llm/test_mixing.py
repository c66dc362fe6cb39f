"""Exponents and budgets against plain computations."""

import math
from collections import Counter

import pytest

from facetra.llm.mixing import mixed, mixture

SHAPE = "doc_id long, text string, source string, tokens string"


def corpus(spark, sizes):
    rows, n = [], 0
    for source, docs in sizes.items():
        for _ in range(docs):
            rows.append((n, "w " * (1 + n % 7), source, "x"))
            n += 1
    return spark.createDataFrame(rows, SHAPE)


def entropy(weights):
    return -sum(w * math.log(w) for w in weights)


def test_exponent_meets_the_entropy(spark):
    counts = spark.createDataFrame([("a", 900), ("b", 80), ("c", 20)], "source string, tokens long")
    m = mixture(counts, entropy=0.9, max_passes=100)
    w = [r.weight for r in m.weights.collect()]
    assert 0 < m.exponent < 1 and abs(entropy(w) - 0.9 * math.log(3)) < 1e-6
    assert mixture(counts, entropy=0.1).exponent == 1.0
    assert mixture(counts, entropy=1.0, max_passes=100).exponent == pytest.approx(0, abs=1e-4)


def test_limit_of_passes_comes_first(spark):
    counts = spark.createDataFrame([("a", 900), ("b", 80), ("c", 20)], "source string, tokens long")
    m = mixture(counts, entropy=1.0, max_passes=3)
    assert max(r.budget / r.tokens for r in m.weights.collect()) == pytest.approx(3, rel=0.06)
    with pytest.raises(ValueError):
        mixture(counts, budget=4000, max_passes=3)


def test_budgets_are_used(spark):
    docs = corpus(spark, {"a": 2000, "b": 200, None: 100})
    rows = mixed(docs, entropy=0.95).collect()
    taken, stock = Counter(), Counter()
    for r in rows:
        taken[r.source] += r.tokens
    counted = docs.selectExpr("source", "1 + doc_id % 7 as n").groupBy("source").sum("n").collect()
    stock = {r[0]: r[1] for r in counted}
    m = mixture(spark.createDataFrame(list(stock.items()), "source string, tokens long"), entropy=0.95)
    for r in m.weights.collect():
        assert r.budget - 7 <= taken[r.source] <= r.budget
    assert len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)


def test_odd_rows(spark):
    rows = [(1, None, "a", None), (2, "", "a", None), (3, "x y", "a", None), (3, "x y", "a", None), (None, "z", None, None), (5, None, "only empty", None)]
    out = mixed(spark.createDataFrame(rows, SHAPE), entropy=0.0).collect()
    assert Counter(r.doc_id for r in out) == Counter({1: 1, 2: 1, 3: 2, None: 1}) or sum(r.tokens for r in out) <= 5
    assert mixed(spark.createDataFrame([], SHAPE)).count() == 0
