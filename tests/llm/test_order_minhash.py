"""Groups against all pairs compared by brute force."""

from difflib import SequenceMatcher

import numpy as np
import pytest

from facetra.llm import order_minhash
from facetra.llm.order_minhash import block_links, close_tiles, items, near_duplicates, normalised, signature, similarity, sketches, word_hashes

SHAPE = "doc_id long, text string, digest string, id string"


def words(rng, n):
    return [f"w{rng.integers(0, 5000)}" for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.integers(0, len(out))] = f"x{rng.integers(0, 10**6)}"
    return out


def brute(texts, least=0.8):
    h = {k: items(normalised(t)) for k, t in texts.items()}
    group = {k: k for k in h}
    for a in h:
        for b in h:
            if a < b and len(h[a]) and len(h[b]) and similarity(h[a], h[b]) >= least:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


def test_items_and_hashes():
    assert len(items(b"")) == 0 and len(items(b"a b")) == 1 and len(items(b"a b c d e f")) == 2
    h = items(normalised("a " * 50))
    assert len(set(h.tolist())) == len(h) == 46
    a, b = word_hashes(b"one two one"), word_hashes(b"zero one")
    assert a[0] == a[2] == b[1] and a[1] != a[0]
    assert sketches(items(b"a b c")) == sketches(items(b"a b c"))


def test_similarity_is_that_of_the_longest_common_order():
    rng = np.random.default_rng(1)
    base = words(rng, 400)
    for edits in (0, 1, 4, 8):
        a, b = items(" ".join(base).encode()), items(" ".join(edited(rng, base, edits)).encode())
        m = SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False)
        lcs = sum(x.size for x in m.get_matching_blocks())
        want = lcs / (len(a) + len(b) - lcs)
        assert similarity(a, b) == pytest.approx(want if want >= 0.8 else 0.0)
    swapped = items(" ".join(base[200:] + base[:200]).encode())
    assert similarity(items(" ".join(base).encode()), swapped) == 0.0


def test_groups(spark):
    rng = np.random.default_rng(2)
    texts = {}
    for g in range(12):
        base = words(rng, int(rng.integers(20, 400)))
        for c in range(int(rng.integers(1, 9))):
            texts[len(texts)] = " ".join(edited(rng, base, c * len(base) // 150))
    passage = words(rng, 60)
    for _ in range(40):  # one passage in many texts
        texts[len(texts)] = " ".join(words(rng, 30) + passage + words(rng, 30))
    rows = [(k, t, "x", "y") for k, t in texts.items()]
    got = {r.doc_id: (r.group_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(4)).collect()}
    want = brute(texts)
    assert {k: g for k, (g, _) in got.items()} == want
    assert all(kept == (k == g) for k, (g, kept) in got.items())


def test_signatures_keep_all_similar_pairs():
    rng = np.random.default_rng(4)
    base = words(rng, 250)
    made = [items(normalised(" ".join(edited(rng, base, int(e))))) for e in rng.integers(0, 12, 60)] + [items(normalised(" ".join(words(rng, 250)))) for _ in range(60)]
    slots = np.array([signature(h) for h in made])
    sizes, own = np.array([len(h) for h in made]), np.arange(120)
    close = lambda part: {(i, j) for a, b in close_tiles(sizes, slots, own, part, 0.8) for i, j in zip(a.tolist(), b.tolist())}
    found = close(own * 0)
    want = {(i, j) for i in range(120) for j in range(i) if similarity(made[i], made[j])}
    assert want <= found and all(i < 60 for i, _ in found)
    assert {(max(x), min(x)) for x in close(own % 2)} == {(i, j) for i, j in found if i % 2 != j % 2}


def joined(n: int, links, start=None) -> list[int]:
    label = list(range(n)) if start is None else list(start)
    for i, j in links:
        label = [label[i] if x == label[j] else x for x in label]
    return [label.index(x) for x in label]


@pytest.mark.parametrize("parts", [1, 2])
def test_block_links_join_what_similar_pairs_connect(parts):
    rng = np.random.default_rng(5)
    made = []
    for size in (250, 120, 30):
        base = words(rng, size)
        made += [items(normalised(" ".join(edited(rng, base, int(e))))) for e in rng.integers(0, 12, 40)]
    made += [items(b"")]
    n = len(made)
    own, part = np.arange(n), np.arange(n) % parts
    similar = [(i, j) for i in range(n) for j in range(i) if similarity(made[i], made[j]) and (parts == 1 or part[i] != part[j])]
    links = block_links(made, own, part, [frozenset([7])] * n, 7, 0.8)
    assert joined(n, links) == joined(n, similar) and len(links) < n < len(similar)
    assert all(similarity(made[i], made[j]) for i, j in links)
    start = own // 3  # components found before stay, and are joined further
    links = block_links(made, start, part, [frozenset([7])] * n, 7, 0.8)
    assert joined(n, links, start) == joined(n, similar, start)
    # Of two buckets that all members share, only the smaller one gives out links.
    assert not block_links(made, own, part, [frozenset([3, 7])] * n, 7, 0.8)


@pytest.mark.parametrize("block", [4096, 7])
def test_chain_and_hot_group(spark, monkeypatch, block):
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = words(rng, 300)
    texts = {}
    for i in range(80):
        texts[i] = " ".join(edited(rng, base, 3))
    step = list(base)
    for i in range(6):  # a chain whose ends are far apart
        step = edited(rng, step, 5)
        texts[100 + i] = " ".join(step)
    rows = [(k, t, "x", "y") for k, t in texts.items()]
    got = {r.doc_id: r.group_id for r in near_duplicates(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("common", [64, 3])
def test_short_texts_are_exact(spark, monkeypatch, common):
    monkeypatch.setattr(order_minhash, "COMMON", common, raising=False)
    rng = np.random.default_rng(7)
    texts = {}
    for n in (8, 9, 10, 12, 16, 28, 53, 54):  # 8 against 9 words: 4 of 5 items; 53 against 54: the end of the index
        for _ in range(25):
            base = words(rng, n)
            texts[len(texts)] = " ".join(base)
            texts[len(texts)] = " ".join(base + words(rng, 1))
            texts[len(texts)] = " ".join(base + words(rng, (n - 4) // 4))
    for _ in range(30):  # items that many texts share
        texts[len(texts)] = " ".join(words(rng, 6) + [f"line{i}" for i in range(12)])
    rows = [(k, t, "x", "y") for k, t in texts.items()]
    got = {r.doc_id: r.group_id for r in near_duplicates(spark.createDataFrame(rows, SHAPE).repartition(4)).collect()}
    want = brute(texts)
    assert want[1] == 0 and got == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!! ..."), (4, "Same words here"), (5, "same, words here!"), (5, "same, words here!"), (6, "short"), (6, "other text"), (None, "same words here"), (7, "short"), (8, "z " * 5000), (9, "z " * 5000 + "y")]
    got = near_duplicates(spark.createDataFrame([(*r, None, None) for r in rows], SHAPE)).collect()
    assert sorted(map(str, ((r.doc_id, r.group_id, r.kept) for r in got))) == sorted(map(str, [
        (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True), (6, 6, True),
        (None, None, True), (7, 6, False), (8, 8, True), (9, 8, False)]))
    assert near_duplicates(spark.createDataFrame([], SHAPE)).count() == 0
