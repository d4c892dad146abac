"""Registered queries of this folder: thin selections over the operators, with SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonance.llm import (
    attribution,
    bpe,
    fingerprint,
    jaccard,
    language,
    lines,
    packing,
    pii,
    toxicity,
    tries,
    vectors,
    warc,
    whitening,
)
from resonance.llm.support import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> bpe.Vocabulary:
    """A public vocabulary, read where the driver runs and sent to the tasks."""
    import public_tokenizers

    return bpe.Vocabulary.read(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), fold(F.col("doc_id"), 4) == 2
    model = language.train(docs.where(~held_out))
    known = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return language.identify(known, model).select("row.doc_id", "row.held_out", "lang_pred", "score")


@query
def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@query
def op3_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir), width=3, num=90, den=100)


SQL["op3_jaccard_groups"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.x, r.c FROM r JOIN e ON e.y = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2"""


@query
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


SQL["op4_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT e.x, r.c FROM r JOIN e ON e.y = r.vec_id),
n AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, min(r.c) AS component_id, m.vec_id = min(r.c) AS kept
FROM embeddings m JOIN r ON r.vec_id = m.vec_id LEFT JOIN n ON n.x = m.vec_id GROUP BY 1, 2"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    known = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return toxicity.score_texts(known, model).select("row.doc_id", "row.held_out", "score", "predicted")


@query
def op6_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return lines.remove_boilerplate(docs).select("row.doc_id", F.col("cleaned").alias("text"), "n_lines", "n_removed")


SQL["op6_boilerplate_lines"] = f"""
WITH l AS (
  SELECT doc_id, source, i AS pos, string_split(text, chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
spread AS (
  SELECT trim(line) AS line FROM l WHERE trim(line) <> '' GROUP BY 1
  HAVING count(DISTINCT source) >= {lines.MIN_SITES}),
placed AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY trim(l.line) ORDER BY doc_id, pos) AS place
  FROM l WHERE trim(line) IN (SELECT line FROM spread)),
gone AS (SELECT doc_id, pos FROM placed WHERE place > 1)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, CASE WHEN g.n > 0 THEN '' ELSE d.text END) END AS text,
  coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(g.n, 0) AS n_removed
FROM documents d
LEFT JOIN (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l
           WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = l.doc_id AND gone.pos = l.pos)
           GROUP BY l.doc_id) k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id"""


@query
def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(documents(spark, sf_dir))


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query
def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


@query
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode_decode(docs, tokenizer("byte_bpe_50k.json"))
    return coded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op11_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


SQL["op12_archived_pages"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m IS NULL OR m IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m IS DISTINCT FROM page_id THEN m END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d"""


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


# CRC-32 of a text's bytes, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
  4294967295)"""

SQL["op13_conversation_trie"] = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d,
    md5(length(role) || ':' || role || text) AS s, strlen(text) AS n FROM b),
p AS (
  SELECT conv_id, d, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, n FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY 1),
g AS (
  SELECT path, d AS depth, left(path, 32 * (d - 1)) AS up, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n,
    sha256(coalesce(string_agg(CASE WHEN d = len THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY 1, 2),
k AS (SELECT up, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k ON k.up = g.path),
s AS (
  SELECT a.path, count(CASE WHEN x.n_children = 0 THEN 1 END) AS n_leaves, CAST(sum((x.n_convs - 1) * x.n) AS BIGINT) AS saved_tokens
  FROM f a JOIN f x ON starts_with(x.path, a.path) GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN f u ON f.depth > 0 AND u.path = f.up"""
