"""Encoding against the public tokenizer library, and round trips."""

import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from facetra.llm.byte_bpe import ByteBPE, encode_digests, encode_documents, read_ranks  # noqa: E402

PATH = public.path("byte_bpe_50k.tiktoken")
CODEC = ByteBPE(read_ranks(PATH), public.PATTERN)
with open(PATH, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
LIBRARY = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = ["", " ", "a", "don't  stop", "ü" * 50, "x" * 3000, "ab" * 2000, "\n\n \t z", "日本語テキスト", "🙂🙃 12345", "<|endoftext|>", "La " * 500]


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinorst hlt'.,0\n éß日"), max_size=80))
def test_random_texts(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_random_bytes_as_one_piece(data):
    assert b"".join(CODEC.tokens[i] for i in CODEC.encode_piece(data)) == data
    text = data.decode("latin-1")
    if LIBRARY.encode_ordinary(text) and len(CODEC.pieces.findall(text)) == 1:
        assert CODEC.encode_piece(text.encode()) == LIBRARY.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, "the cat", "a"), (1, "the cat", "a"), (None, None, None), (2, "", "b"), (3, HARD[5], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens): r for r in encode_documents(docs, PATH, public.PATTERN).collect()}
    assert got[(1, 2)].decoded == b"the cat" and got[(None, 0)].ids == b""
    digests = encode_digests(docs, PATH, public.PATTERN).collect()
    assert len(digests) == 5
    for r in digests:
        text = next(x[1] or "" for x in rows if x[0] == r.doc_id)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode_digests(docs.limit(0), PATH, public.PATTERN).count() == 0


def test_vocabulary_without_all_bytes():
    with pytest.raises(ValueError):
        ByteBPE([b"a", b"b"], public.PATTERN)


def test_neighbours_without_merging_them(monkeypatch):
    rng = np.random.default_rng(3)
    codec = ByteBPE(CODEC.tokens, public.PATTERN)
    pairs = np.concatenate([rng.integers(0, 2_000, (1_500, 2)), rng.integers(0, len(CODEC.tokens), (500, 2))]).tolist()
    pairs += [codec.split(t) for t in range(1_000, 1_500)]
    want = [codec.merged(codec.tokens[a] + codec.tokens[b]) == [a, b] for a, b in pairs]
    assert 500 < sum(want) <= 2_000
    monkeypatch.setattr(codec, "merged", None)  # each pair took merges of all its bytes
    assert [codec.compatible(a, b) for a, b in pairs] == want


def test_neighbours_in_odd_vocabularies():
    # "xy" ranks after "xyz", which it is merged into; "pqr" is never made; runs of one letter tie
    more = [b"aa", b"aaaa", b"xyz", b"xy", b"pqr", b"zx", b"yzx", b"ab", b"aab", b"baa"]
    codec = ByteBPE([bytes([i]) for i in range(256)] + more, public.PATTERN)
    some = [*range(256, 256 + len(more)), *b"abxyzpqr"]
    for a in some:
        for b in some:
            assert codec.compatible(a, b) == (codec.merged(codec.tokens[a] + codec.tokens[b]) == [a, b])
