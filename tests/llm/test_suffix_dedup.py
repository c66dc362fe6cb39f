"""Repeated strings against a plain count of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from facetra.llm import suffix_dedup
from facetra.llm.suffix_dedup import dedup, equal_windows, spans_of

SHAPE = "doc_id long, text string, n_bytes long, digest string"


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for i, b in enumerate(t) if not gone[i + 1])
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def letters(rng, n, symbols="abcdefgh é"):
    return "".join(rng.choice(list(symbols), n))


@pytest.mark.parametrize("length", [2, 5, 40])
def test_equal_windows(length):
    rng = np.random.default_rng(length)
    base = bytes(rng.integers(0, 3, 300, dtype=np.uint8))
    spans = [base[i : i + n] for i, n in zip(rng.integers(0, 200, 30), rng.integers(0, 100, 30))] + [b"\0" * 70, b"", b"\xff\0" * 30]
    span, offset, group = equal_windows(spans, length)
    want: dict[bytes, set] = {}
    for s, o, g in zip(span.tolist(), offset.tolist(), group.tolist()):
        want.setdefault(spans[s][o : o + length], set()).add(g)
    assert sum(max(0, len(s) - length + 1) for s in spans) == len(span)
    assert all(len(g) == 1 for g in want.values()) and len({min(g) for g in want.values()}) == len(want)


def test_spans_cover_all_windows(monkeypatch):
    rng = np.random.default_rng(0)
    data = letters(rng, 3000).encode() + b"ab" * 2000
    whole = spans_of(data, 150)
    for chunk in (1 << 20, 700):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        anchor, _, start, size, _ = spans_of(data, 150)
        assert start[0] == 0 and (start[1:] == start[:-1] + size[:-1]).all() and start[-1] + size[-1] == len(data) - 149
        assert (np.repeat(anchor, size) == np.repeat(whole[0], whole[3])).all() and size.max() <= suffix_dedup.RUN
    assert len(spans_of(b"x" * 149, 150)[0]) == 0 and len(spans_of(b"", 150)[0]) == 0


@pytest.mark.parametrize("spans", [2000, 3])
def test_against_all_windows(spark, monkeypatch, spans):
    monkeypatch.setattr(suffix_dedup, "SPANS", spans)
    rng = np.random.default_rng(7)
    passage = [letters(rng, n) for n in (399, 300, 500, 1200)]
    texts = []
    for i in range(40):
        parts = [letters(rng, int(rng.integers(0, 300)))]
        for _ in range(int(rng.integers(0, 3))):
            p = passage[rng.integers(0, 4)]
            a = int(rng.integers(0, 40))
            parts += [p[a:], letters(rng, int(rng.integers(0, 200)))]
        texts.append("".join(parts))
    texts += [texts[3]] * 3 + ["La " * 700, "x" * 399, "x" * 400, "x" * 401, "", "ab" * 210, letters(rng, 500) * 2]
    near = list(passage[3])
    for i in (100, 600, 640, 1100):
        near[i] = "#"
    texts += ["".join(near), passage[3][:800] + passage[3][790:]]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = dedup(spark.createDataFrame(rows, SHAPE).repartition(4)).orderBy("doc_id").collect()
    want = brute([t.encode() for t in texts], 400)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want
    for r, t in zip(got, texts):
        gone = b"".join(t.encode()[x.lo : x.hi] for x in r.removed)
        assert len(gone) + len(r.kept) == len(t.encode()) and len(gone) == r.n_removed


@pytest.mark.parametrize("length", [128, 200, 400])
def test_refined_runs_hold_each_window_once_and_equal_ones_together(length):
    rng = np.random.default_rng(length)
    line = bytes(rng.integers(97, 123, 90).astype(np.uint8))
    texts = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) + line + bytes(rng.integers(97, 123, 700).astype(np.uint8)) for n in rng.integers(0, 500, 12)]
    texts += [t[50:] for t in texts[:4]] + [t[:-40] + b"x" * 40 for t in texts[:4]] + [line * 12, b"ab" * 600]
    low, high = suffix_dedup.cores(length)
    place = np.arange(len(low))
    assert (place + low >= 0).all() and (place + high <= length).all() and (high - place <= length).all()
    names, pieces = {}, 0
    for text in texts:
        anchors, _, starts, sizes, _ = suffix_dedup.spans_of(text, length)
        for anchor, start, size in zip(anchors.view(np.int64).tolist(), starts.tolist(), sizes.tolist()):
            span, at = text[start : start + size + length - 1], 0
            for name, first, number in suffix_dedup.refined(span, anchor, length, low, high):
                assert first == at
                at += number
                pieces += 1
                for i in range(first, at):
                    assert names.setdefault(span[i : i + length], name) == name
            assert at == size
    assert len(set(names.values())) > len(texts) and pieces


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "y" * 500), (3, "y" * 500), (None, "z" * 399), (None, "z" * 398)]
    got = dedup(spark.createDataFrame([(*r, None, None) for r in rows], SHAPE), texts=False).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in got) == sorted(
        [("1", 0, 0, 0), ("2", 0, 0, 0), ("3", 500, 500, 1), ("3", 500, 500, 1), ("None", 399, 0, 0), ("None", 398, 0, 0)]
    )
    assert dedup(spark.createDataFrame([], SHAPE)).count() == 0
    with pytest.raises(ValueError):
        dedup(spark.createDataFrame([], SHAPE), length=100)


def test_texts_of_one_row_bring_their_columns_along(spark):
    rng = np.random.default_rng(11)
    some = letters(rng, 600)
    rows = [(1, some + "a", "x"), (2, "b" + some, None), (None, letters(rng, 300), "y"), (4, "", "p"), (5, None, "q"), (6, "short", None), (6, "short", None), (7, some, "z"), (8, some, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = dedup(docs, length=200, carry=["lang"])
    assert found.columns == ["doc_id", "lang", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
    got = sorted(((r.doc_id, r.lang, bytes(r.kept).decode(), [tuple(x) for x in r.removed]) for r in found.collect()), key=str)
    size = len(some.encode())
    gone = {1: [(0, size)], 2: [(1, size + 1)], 7: [(0, size)], 8: [(0, size)]}
    kept = {1: "a", 2: "b", 7: "", 8: ""}
    assert got == sorted([(k, c, kept.get(k, t or ""), gone.get(k, [])) for k, t, c in rows], key=str)
    # kept texts of single rows are not shuffled: at most one of the two steps that cut is below an exchange or broadcast
    above, below = [], 0
    for line in found._jdf.queryExecution().sparkPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*"))
        above = [x for x in above if x[0] < at] + [(at, line)]
        below += "MapInArrow applied" in line and any("Join" in x for _, x in above)
    assert below == 1 and found._jdf.queryExecution().sparkPlan().toString().count("MapInArrow applied") == 2
    with pytest.raises(ValueError):
        dedup(docs.withColumnRenamed("lang", "digest"), carry=["digest"])
