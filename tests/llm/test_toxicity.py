"""Decoding of disguised words and held-out accuracy."""

import numpy as np
import pytest

from facetra.llm.toxicity import CharacterModel, Restorer, character_counts, decode, disguised, fit, score

INSULTS = ["blockhead", "numskull", "dimwit"]
SHAPE = "doc_id long, text string, toxic int, score double"


def plain(rng, n):
    return [str(rng.choice(["river", "table", "window", "garden", "letter", "silver", "morning", "paper"])) for _ in range(n)]


def corpus(n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words, toxic = plain(rng, 30), int(i % 4 == 0)
        if toxic:
            words[rng.integers(0, 30)] = str(rng.choice(INSULTS))
        rows.append((i, " ".join(words), toxic, None))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return CharacterModel(character_counts(spark.createDataFrame(corpus(), SHAPE)))


@pytest.mark.parametrize("word,plain", [(b"bl0ckh3ad", b"blockhead"), (b"d 1 m w i t", b"dimwit"), (b"nuuuumskull", b"numskull"), (b"d.i.m.w.i.t", b"dimwit"), (b"d*mw*t", b"dimwit"), (b"garden", b"garden")])
def test_decode(model, word, plain):
    assert decode(word, model) == plain


def test_only_disguised_spans_are_decoded():
    assert disguised(b"a plain text, with commas. and stops!") == set()
    assert disguised(b"some d1mwit here") == {b"d1mwit"}
    assert b"d i m w i t" in disguised(b"a big d i m w i t today")
    assert disguised(b"") == set() and disguised(b"1 2") == set()


def test_long_spans_are_covered(model):
    text = "x1" * 5000 + "bl0ckhead" + "1x" * 5000
    assert any(b"blockhead" in w for w in Restorer(model).restored(text.encode()))


def test_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    c = fit(docs, docs.filter("doc_id % 2 = 0"), least=2)
    got = {r.doc_id: r for r in score(docs, c).collect()}
    assert all(got[i].predicted == toxic for i, _, toxic, _ in rows)
    hidden = ["you d1mw1t go", "n u m s k u l l river", "bl0ckhe@d", "BLOCKHEAD!!!", "dimmmmwit"]
    new = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(hidden)] + [(9, "river table", None, None)], SHAPE)
    assert [r.predicted for r in score(new, c).orderBy("doc_id").collect()] == [1] * len(hidden) + [0]


def test_odd_rows(spark):
    rows = [(1, None, 1, None), (2, "", 0, None), (3, "abc", None, None), (3, "abc", None, None), (None, "x " * 30000, 0, None)]
    docs = spark.createDataFrame(rows, SHAPE)
    got = score(docs, fit(docs, docs)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert score(docs, fit(empty, empty)).count() == 5
    assert score(empty, fit(docs, docs.filter("toxic = 0"))).count() == 0


@pytest.mark.parametrize("text", ["gru7", "gru7, and", "(gru7)", "gru+", "gru+!", "gri!!", "g  r  u  t", "g · r · u · t", "g·r·u·t", "g\u200br\u200bu\u200bt", "“grut”", "(rut"])
def test_signs_at_the_end_and_far_separators(text):
    counts = np.zeros(27**4, np.int64)
    for word in (b"   grut ", b"   crut ", b"   gril "):
        codes = np.array([0 if b == 32 else b - 96 for b in word])
        for i in range(len(codes) - 3):
            counts[int(np.dot(codes[i : i + 4], [27**3, 27**2, 27, 1]))] += 500
    assert Restorer(CharacterModel(counts)).words("so " + text) & {b"grut", b"crut", b"gril"}
