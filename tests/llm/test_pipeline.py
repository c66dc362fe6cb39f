"""The stages on a small table, each against a plain version of its work."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline

EN = "the and of to in that with for was his from are this have not but had which one you were all their there been".split()
DE = "der die und das ist nicht ein eine auf mit sich dem von zu den auch als wird oder aber wenn nur noch bei".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)

    def text(words, n):
        return " ".join(f"{w}{rng.integers(0, 40)}" if rng.random() < 0.4 else w for w in rng.choice(words, n))

    rows = []

    def add(text, lang):
        rows.append((len(rows), text, lang, f"s{len(rows) % 3 if len(rows) % 4 else 0}", len(text or "")))

    for i in range(60):
        add(text(EN if i % 2 else DE, int(rng.integers(40, 200))), "en" if i % 2 else "de")
    copied = [rows[k][1] for k in (1, 2, 3)]
    for t in copied:
        add(t, "en")  # exact copies
        add(t + " further", "en")
    passage = text(EN, 120)
    for _ in range(4):
        add(text(EN, 150) + " " + passage + " " + text(EN, 150), "en")
    add("%% 123 ++", "en")
    add("", "de")
    add(None, None)
    place = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{place}/documents.parquet")
    return str(place), rows


def test_stages(spark, folder):
    place, rows = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, place), name)
        seen[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == pipeline.COLUMNS
    texts = {r[0]: r[1] for r in rows}
    wordless = {k for k, t in texts.items() if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in seen["language"]} == set(texts) - wordless
    ids = {r.doc_id for r in seen["near_duplicates"]}
    assert ids == set(texts) - wordless - set(range(60, 66))
    whole = {i: texts[i].encode() for i in ids}
    counts = Counter(t[i : i + 400] for t in whole.values() for i in range(len(t) - 399))
    for r in seen["suffix_dedup"]:
        t, gone = whole[r.doc_id], set()
        for i in range(len(t) - 399):
            if counts[t[i : i + 400]] > 1:
                gone |= set(range(i, i + 400))
        assert r.text.encode() == bytes(b for i, b in enumerate(t) if i not in gone) and r.n_chars == len(r.text)
    mixed = Counter(r.doc_id for r in seen["mixing"])
    assert set(mixed) <= ids and max(mixed.values()) <= 4 and len(mixed) > len(ids) / 2
    left = {r.doc_id: r.text for r in seen["suffix_dedup"]}
    assert Counter(r.doc_id for r in seen["byte_bpe"]) == mixed
    for r in seen["byte_bpe"]:
        assert r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()


def test_run_and_odd_rows(spark, folder, tmp_path):
    assert pipeline.run(spark, folder[0]).count() > 30
    rows = [(None, "the and of", None, None, None), (1, "the and of to in", "en", "a", 3), (1, "the and of to in", "en", "a", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() <= 2
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
