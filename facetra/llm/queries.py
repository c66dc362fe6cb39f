"""The registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, language, maxent, mixing, order_minhash, packing, prefix_trie, small_world, suffix_dedup, top_k, toxicity, warc, whitening
from .common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


ENTROPY = 0.98
MAX_PASSES = 4.0
MIX_SQL = f"""
WITH RECURSIVE counted AS (
  SELECT doc_id AS doc, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
sources AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM counted GROUP BY source HAVING sum(tokens) > 0),
shares AS (SELECT source, tokens, tokens / CAST((SELECT sum(tokens) FROM sources) AS DOUBLE) AS s FROM sources),
target AS (SELECT CAST({ENTROPY} AS DOUBLE) * ln(count(*)) - CAST(1e-12 AS DOUBLE) AS h FROM shares),
search AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT step + 1, CASE WHEN h >= (SELECT h FROM target) THEN middle ELSE low END,
         CASE WHEN h >= (SELECT h FROM target) THEN high ELSE middle END
  FROM (SELECT step, low, high, (low + high) / 2 AS middle,
               (SELECT ln(sum(pow(s, (low + high) / 2))) - (low + high) / 2 * sum(pow(s, (low + high) / 2) * ln(s)) / sum(pow(s, (low + high) / 2)) FROM shares) AS h
        FROM search WHERE step < 30)),
exponent AS (
  SELECT CASE WHEN (SELECT -sum(s * ln(s)) FROM shares) >= (SELECT h FROM target) THEN CAST(1 AS DOUBLE)
              ELSE (SELECT max(low) FROM search) END AS a),
weights AS (
  SELECT source, tokens, CAST(floor(round(pow(s, a) / (SELECT sum(pow(s, (SELECT a FROM exponent))) FROM shares), 9)
         * (SELECT CAST(sum(tokens) AS DOUBLE) FROM sources)) AS BIGINT) AS budget FROM shares, exponent),
blocks AS (SELECT source, substr(digest, 1, 3) AS block, CAST(sum(tokens) AS BIGINT) AS block_tokens FROM counted GROUP BY ALL),
passes AS (
  SELECT b.source, block, block_tokens, tokens, budget, budget // tokens AS "full", unnest(range(0, CAST(budget // tokens AS BIGINT) + 1)) AS pass
  FROM blocks b JOIN weights w ON b.source IS NOT DISTINCT FROM w.source),
ordered AS (
  SELECT *, md5('mix|' || coalesce(source, 'null') || '|' || CAST(pass AS VARCHAR) || '|' || block) AS shuffled FROM passes),
placed AS (
  SELECT *, row_number() OVER w AS place, sum(block_tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS through FROM ordered
  WINDOW w AS (PARTITION BY source, pass ORDER BY shuffled, block)),
plan AS (
  SELECT source, block, pass, place, block_tokens,
         CASE WHEN pass < "full" THEN block_tokens ELSE budget - "full" * tokens - through + block_tokens END AS "left" FROM placed),
taken AS (
  SELECT doc, c.source, tokens, pass, block, place, "left", block_tokens,
         sum(tokens) OVER (PARTITION BY c.source, block, pass ORDER BY digest RANGE UNBOUNDED PRECEDING) AS so_far
  FROM counted c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source AND substr(c.digest, 1, 3) = p.block WHERE "left" > 0)
SELECT doc AS doc_id, source, tokens, CAST(pass AS INTEGER) AS pass, block, CAST(place AS INTEGER) AS place
FROM taken WHERE "left" >= block_tokens OR so_far <= "left"
"""


@query("op1_mixing", MIX_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mixture, one row per pass."""
    return mixing.mixed(table(spark, folder, "documents"), entropy=ENTROPY, max_passes=MAX_PASSES)


@query("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without strings of 400 bytes that occur elsewhere too."""
    return suffix_dedup.dedup(table(spark, folder, "documents"), length=400, texts=False)


TOP_SQL = """
WITH scaled AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op3_exact_top_k", TOP_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows of every fiftieth vector."""
    vectors = top_k.scaled(table(spark, folder, "embeddings"))
    return top_k.exact_top_k(vectors, vectors.filter(F.col("id") % 50 == 0), k=5)


@query("op4_maxent")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under token counts and under the model."""
    return maxent.score_texts(table(spark, folder, "documents"), remainder(F.col("doc_id"), 7) == 2)


@query("op5_language")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page; the text models come from all labelled documents."""
    model = language.fit_text_model(table(spark, folder, "documents"))
    pages = table(spark, folder, "pages")
    host = language.host_of(F.col("url"))
    found = language.identify(pages, model, "page_id", F.col("html"), host, language.suffix_of(host), markup=True)
    return found.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "declared", "host")


WARC_SQL = r"""
WITH hashed AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]+', ' ', 'g') AS url, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes,
         sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, 1 + 10 * CAST(i // 8 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded),
named AS (
  SELECT *, page_id IS NOT DISTINCT FROM first AS own, chr(13) || chr(10) AS nl,
         regexp_replace(sha1('record:' || coalesce(CAST(page_id AS VARCHAR), 'null')), '^(.{8})(.{4})(.{4})(.{4})(.{12}).*$', '<urn:uuid:\1-\2-\3-\4-\5>') AS own_id,
         regexp_replace(sha1('record:' || coalesce(CAST(first AS VARCHAR), 'null')), '^(.{8})(.{4})(.{4})(.{4})(.{12}).*$', '<urn:uuid:\1-\2-\3-\4-\5>') AS first_id FROM firsts),
records AS (
  SELECT *, concat_ws(nl, 'WARC/1.1', 'WARC-Type: ' || CASE WHEN own THEN 'response' ELSE 'revisit' END, 'WARC-Record-ID: ' || own_id,
         'WARC-Date: 2000-01-01T00:00:00Z', 'WARC-Target-URI: ' || url, 'WARC-Payload-Digest: sha1:' || payload_digest,
         CASE WHEN NOT own THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END,
         CASE WHEN NOT own THEN 'WARC-Refers-To: ' || first_id END, 'Content-Type: text/html; charset=utf-8',
         'Content-Length: ' || CAST(CASE WHEN own THEN payload_bytes ELSE 0 END AS VARCHAR)) || nl || nl || payload || nl || nl AS record FROM named)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN NOT own THEN first END AS refers_to, CAST(strlen(record) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256 FROM records
"""


@query("op6_warc", WARC_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every page through the archive and back, with length and digest of the record that was rebuilt."""
    archive = warc.write_archive(table(spark, folder, "pages"))
    rebuilt = F.length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256")
    return warc.restore(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *rebuilt)


@query("op7_order_minhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return order_minhash.near_duplicates(table(spark, folder, "documents"))


WORLD_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= CAST(0.93 AS DOUBLE)),
reach AS (SELECT vec_id AS id, vec_id AS other FROM usable UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
lowest AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN lowest ON vec_id = id LEFT JOIN counts ON vec_id = a
"""


@query("op8_small_world", WORLD_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of every vector at a cosine of 0.93."""
    return small_world.near_duplicates(table(spark, folder, "embeddings"), least=0.93)


@query("op9_byte_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and their decoded bytes, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_digests(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels of held-out rows are not used."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    labels = table(spark, folder, "labels").filter(~held_out).select("doc_id", "toxic")
    classifier = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, classifier)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, count(*) AS own, conv_id - ((conv_id % 20) + 20) % 20 AS base,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
             lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])),
             lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END)), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM t GROUP BY conv_id),
plan AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS borrowed FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (
  SELECT p.conv_id, t.pos, role, text FROM plan p JOIN t ON t.conv_id = p.base AND t.pos <= p.h
  UNION ALL SELECT p.conv_id, t.pos - p.h + p.borrowed, role, text FROM plan p JOIN t ON t.conv_id = p.conv_id AND t.pos > p.h),
paths AS (
  SELECT conv_id, CAST(pos AS BIGINT) AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         string_agg(md5(CAST(length(role) AS VARCHAR) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS node, pos = count(*) OVER (PARTITION BY conv_id) AS last
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '', borrowed + greatest(0, own - h) = 0 FROM plan),
nodes AS (
  SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM paths GROUP BY node),
kids AS (SELECT left(node, length(node) - 32) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
spread AS (
  SELECT left(n.node, 32 * n.d) AS node, sum(n.saved) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) n LEFT JOIN kids k ON k.node = n.node GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN spread s USING (node) LEFT JOIN kids k USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = left(n.node, length(n.node) - 32)
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.trie(table(spark, folder, "conversations"))


@query("op12_packing")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every document's pieces in sequences of 2,048 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2_048)


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The first eight whitened coordinates of every vector."""
    return whitening.whiten(table(spark, folder, "embeddings"), components=8)
