"""Packing: ids against the library, places against the rules, bins against exhaustive search."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from facetra.llm import packing
from facetra.llm.packing import WordEncoder, best_fit, least_bins, pack, pack_documents, search

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " a  b\tc\nd", "İstanbul Ǆ K ΑΣ. don't I'LL 12ab３ ²½ x\x1cy z\x85w", "é ́a ño", "a" * 3000, "中文 <|endoftext|> ok<|startoftext|>", "it's'sd''ll Ÿ ÀÉ ẞ ß ſ ŉ × ÷ ª µ", "\x00 \x01 a\x00b﻿🙂"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_of_odd_texts(library):
    encoder = WordEncoder(PATH)
    assert encoder.own
    flat, ends = encoder.encode(pa.array(ODD))
    got = np.split(flat, ends[:-1])
    assert [g.tolist() for g in got] == [library(x) for x in ODD]
    flat, ends = encoder.encode(pa.array([], pa.string()))
    assert len(flat) == 0 and len(ends) == 0


_ENCODER = WordEncoder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(library, text):
    text = text.encode("utf-8", "ignore").decode()
    flat, _ = _ENCODER.encode(pa.array([text]))
    assert flat.tolist() == library(text)


def test_words_with_signs_skip_the_splitter(library, monkeypatch):
    encoder = WordEncoder(PATH)
    chunks = ["the", "Éénle.", "don't", "dogs'", "it's,", "a\"),", "×÷", "ªµ", "İx.", "ŉŸſ!", "x1.", "...", "ß"]
    assert [np.frombuffer(encoder._chunk(c), "<u4").tolist() for c in chunks] == [library(c) for c in chunks]
    monkeypatch.setattr(packing, "WORDS", None)  # every plain chunk was split by it
    assert encoder._chunk("Qué;") == encoder.words["qué"] + encoder.words[";"]


def fewest(sizes, capacity):
    """Bins needed, by trying all orders of first fit."""
    best = len(sizes)
    for order in set(itertools.permutations(sizes)):
        bins = []
        for s in order:
            at = next((i for i, b in enumerate(bins) if b + s <= capacity), None)
            if at is None:
                bins.append(s)
            else:
                bins[at] += s
        best = min(best, len(bins))
    return best


def test_bins_of_small_sets():
    rng = np.random.default_rng(2)
    total = wanted = 0
    for _ in range(150):
        sizes = rng.integers(1, 13, rng.integers(1, 7))
        start = best_fit(sizes, 12)
        bins = search(sizes, start, 12)
        fill, need = np.bincount(bins, sizes), fewest(sizes.tolist(), 12)
        assert fill.max() <= 12 and least_bins(sizes, 12) <= need <= len(set(bins)) <= len(set(start))
        total, wanted = total + len(set(bins)), wanted + need
    assert total <= 1.01 * wanted


def test_search_saves_bins():
    rng = np.random.default_rng(1)
    for low, high in ((650, 720), (500, 1100)):
        sizes = rng.integers(low, high, 1000)
        start = best_fit(sizes, 2048)
        bins = search(sizes, start, 2048)
        assert np.bincount(bins, sizes).max() <= 2048
        assert len(set(bins)) < 0.98 * len(set(start))


def placed_well(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_groups_meet_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rng = np.random.default_rng(5)
    sizes = [int(s) for s in rng.integers(1, 400, 1000)] + [512] * 5
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long").repartition(4)
    rows = pack(df, 512).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(sizes))
    assert placed_well(rows, 512) <= 1.01 * least_bins(np.array(sizes), 512) + 1


def test_documents(spark, library):
    texts = [*ODD, None, "one two three " * 900, "same", "same"]
    docs = spark.createDataFrame([(i % 11 or None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    rows = pack_documents(docs, PATH).collect()
    want = []
    for i, t in enumerate(texts):
        ids = library(t or "") + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.append((i % 11 or -1, n, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert placed_well(rows, 2048) == least_bins(np.array([w[3] for w in want]), 2048)
    assert pack_documents(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="rename"):
        pack(docs.selectExpr("doc_id", "1L as length", "2 as offset"), 10)
