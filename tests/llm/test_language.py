"""Languages of small pages, and priors against plain arithmetic."""

import pytest
from pyspark.sql import functions as F

from facetra.llm.language import fit_text_model, host_of, identify, suffix_of, visible_text

TRAIN = {
    "en": "the cat and the dog went with their owner to the house on the hill where they were fed",
    "de": "der hund und die katze gingen mit ihrem besitzer zu dem haus auf dem berg und wurden gefuettert",
    "fr": "le chat et le chien sont alles avec leur maitre a la maison sur la colline pour etre nourris",
}
SHAPE = "page_id long, url string, html string, language string, host string"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, lang, None) for lang, t in TRAIN.items() for _ in range(20)] + [(None, "en", None), ("x", None, None)]
    return fit_text_model(spark.createDataFrame(rows, "text string, lang string, n int").repartition(3))


def run(spark, model, rows, **more):
    df = spark.createDataFrame([(*r, None, None) for r in rows], SHAPE)
    host = host_of(F.col("url"))
    return {r.page_id: r for r in identify(df, model, "page_id", F.col("html"), host, suffix_of(host), markup=True, **more).collect()}


def test_visible_text():
    page = b"<html lang='de'><head><script>var t='</p>';</script><style>p{}</style></head><p>a &amp; b<!-- c -->d"
    assert visible_text(page).split() == [b"a", b"&", b"b", b"d"]
    assert visible_text(b"<script " * 20000) is not None and visible_text(b"<script>x") == b" "


def test_hosts(spark):
    urls = ["http://www.A.example.de:80/x", "https://u:p@b.fr", "ftp://c?x", "no address", None]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(host_of(F.col("url")).alias("h")).select("h", suffix_of(F.col("h"))).collect()
    assert [r[0] for r in got] == ["a.example.de", "b.fr", "c", None, None]
    assert [r[1] for r in got[:2]] == ["de", "fr"]


def test_text_decides(spark, model):
    rows = [(i, "http://h.org/", f"<p>{t}</p>") for i, t in enumerate(TRAIN.values())]
    assert [run(spark, model, rows)[i].language for i in range(3)] == list(TRAIN)


def test_host_and_markup_decide_short_texts(spark, model):
    rows = [(i, "http://a.de/", f"<p>{TRAIN['de']}</p>") for i in range(12)] + [(50 + i, "http://b.fr/", f"<p>{TRAIN['fr']}</p>") for i in range(12)]
    rows += [(100, "http://a.de/x", "<p>xq</p>"), (101, "http://b.fr/x", "<p>xq</p>"), (102, None, "<html lang=fr-CA><p>xq</p>"), (103, "http://other.de/", "<p>xq</p>")]
    got = run(spark, model, rows, confidence=0.4)
    assert [got[i].language for i in (100, 101, 102, 103)] == ["de", "fr", "fr", "de"]
    assert got[102].declared == "fr"


def test_odd_rows(spark, model):
    rows = [(1, None, None), (2, "", ""), (3, "http://x/", "<p>123 !!</p>"), (4, "http://x/", TRAIN["en"] * 4000), (4, "http://x/", TRAIN["en"]), (None, "http://x/", TRAIN["fr"])]
    got = run(spark, model, rows)
    assert [got[i].language for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "fr"]
    assert got[1].confidence == 0.0
    assert run(spark, model, []) == {}
    nothing = fit_text_model(spark.createDataFrame([], "text string, lang string"))
    assert {r.language for r in run(spark, nothing, rows).values()} == {"und"}


def test_bytes_at_random_are_rejected(spark, model):
    import random

    random.seed(1)
    junk = "".join(chr(random.randrange(0x4E00, 0x9FFF)) for _ in range(600))
    assert run(spark, model, [(1, None, junk), (2, None, TRAIN["en"])])[1].language == "und"
