"""The trie against one built node by node."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from facetra.llm import prefix_trie
from facetra.llm.prefix_trie import trie

SHAPE = "conv_id long, turn int, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(rs)] for c, rs in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            members.setdefault(tuple(full[:d]), []).append(c)
        ends.setdefault(tuple(full), []).append(c)
    out = set()
    for node, convs in members.items():
        d = len(node)
        below = [m for m in members if m[:d] == node]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        leaves = sum(not any(k[: len(m)] == m and len(k) == len(m) + 1 for k in members) for m in below)
        children = sum(len(k) == d + 1 and k[:d] == node for k in members)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), d, parent, len(convs), children, leaves, saved, hashlib.sha256(ids.encode()).hexdigest()))
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("chunk", [4_096, 3])
def test_random(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    rows = []
    for c in sorted(rng.choice(120, 60, replace=False).tolist()):
        for turn in range(rng.integers(1, 9)):
            rows.append((c, turn, ["user", "bot"][turn % 2], " ".join(["w"] * int(rng.integers(0, 3)))))
    rows += [(7, t, "user", f"step {t}") for t in range(10, 45)]  # a chain
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    assert found(trie(df)) == brute(rows)


def test_hot_keys_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT", 5)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = [(c, 0, "user", "hi there") for c in range(60)] + [(c, 1, "bot", f"answer {c}") for c in range(30)]
    rows += [(5, 2, "user", "again")] * 9 + [(5, None, None, None)] * 2
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert found(trie(df)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (-3, 0, "u", "a"), (-20, 0, "u", "b c"), (3, 1, None, None), (3, 1, "u", "x y"), (3, None, "u", "first"), (2**40, 0, "u", "z" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], SHAPE + ", depth int, x string")
    assert found(trie(df)) == brute(rows)
    assert trie(df.limit(0)).count() == 0
    turnless = [(c, 0, "u", "one") for c in range(1, 20)]  # no base, few turns
    assert found(trie(spark.createDataFrame(turnless, SHAPE))) == brute(turnless)


def test_long_chains(spark):
    rows = [(0, t, "u", f"t {t}") for t in range(300)] + [(20, t, "u", f"t {t}") for t in range(150)] + [(20, 150, "u", "other")]
    assert found(trie(spark.createDataFrame(rows, SHAPE))) == brute(rows)
