"""Text, category and numeric features over whole tables and whole texts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from resonance.catalog.common import POSTS, TYPED, r, register, rounded
from resonance.functions import scalars as S
from resonance.functions.text import ENGLISH_STOP_WORDS
from resonance.operators import features
from resonance.plans import standins

_STOPS = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
# Words and word pairs of every document.
TERMS = rf"""u AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
      lambda w: w NOT IN ({_STOPS})) AS u FROM documents),
  terms AS (SELECT doc_id, unnest(list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])))
      AS term FROM u)"""
TF = f"{TERMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2)"
VOCAB = f"""{TF}, vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY term
      ORDER BY 2 DESC, term LIMIT 3000)"""


def _documents(spark, sf_dir):
    return standins.documents(spark, sf_dir)


@register("e4_term_counts", f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def e4_term_counts(spark, sf_dir):
    return features.term_counts(_documents(spark, sf_dir), "doc_id", "text")


@register("e5_vocabulary", f"WITH {VOCAB} SELECT term, tf, df FROM vocab")
def e5_vocabulary(spark, sf_dir):
    return features.vocabulary(_documents(spark, sf_dir), "text")


@register(
    "e6_tfidf_weights",
    f"""WITH {VOCAB},
    w AS (SELECT t.doc_id, t.term, t.tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + v.df)) + 1) AS w
          FROM tf t JOIN vocab v ON v.term = t.term)
    SELECT doc_id, term, {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w""",
)
def e6_tfidf_weights(spark, sf_dir):
    long = features.tfidf_long(_documents(spark, sf_dir), "doc_id", "text")
    return long.select("doc_id", "term", rounded("weight").alias("weight"))


_SCALED = ("weekday", "month", "hour", *standins.METRICS)


@register(
    "e1_standard_scores",
    f"WITH {POSTS} SELECT post_id, "
    + ", ".join(
        r(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END")
        + f" AS {c}"
        for c in _SCALED
    )
    + " FROM posts",
)
def e1_standard_scores(spark, sf_dir):
    scaled = features.standard_scale(standins.posts(spark, sf_dir), _SCALED)
    return scaled.select("post_id", *[rounded(c).alias(c) for c in _SCALED])


_KINDS = sorted(S.POST_TYPES)


@register(
    "e2_one_hot_post_type",
    f"WITH {TYPED} SELECT post_id, "
    + ", ".join(f"CASE WHEN post_type = '{k}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_{k.lower()}" for k in _KINDS)
    + " FROM kinds",
)
def e2_one_hot_post_type(spark, sf_dir):
    flags = standins.post_types(spark, sf_dir).select("post_id", features.one_hot(F.col("post_type")).alias("f"))
    return flags.select("post_id", *[F.col("f")[i].alias(f"is_{k.lower()}") for i, k in enumerate(_KINDS)])


@register("e7_text_embeddings")
def e7_text_embeddings(spark, sf_dir):
    """Vector of every document, with its length (0 for a text without terms)."""
    vectors = features.hashed_embedding(_documents(spark, sf_dir).select("doc_id", "text"), "text")
    return vectors.select("doc_id", rounded(features.vector_norm("embedding")).alias("norm"),
                          vector_to_array("embedding").alias("embedding"))


@register(
    "e7_embedding_lengths",
    f"WITH {TF} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM tf) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents",
)
def e7_embedding_lengths(spark, sf_dir):
    """The vector of every document has length 1 if the document has a term, else 0."""
    vectors = features.hashed_embedding(_documents(spark, sf_dir).select("doc_id", "text"), "text")
    return vectors.select("doc_id", rounded(features.vector_norm("embedding")).alias("norm"))


@register(
    "e7_precomputed_embeddings",
    f"""SELECT d.doc_id AS vec_id, e.label, {r('sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x)))', 4)}
      AS norm FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def e7_precomputed_embeddings(spark, sf_dir):
    """All documents with their stored vectors; those without one keep a null."""
    vectors = standins.table(spark, sf_dir, "embeddings")
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("vec_id"))
    out = features.joined_embedding(docs, vectors, "vec_id", "embedding").join(vectors.select("vec_id", "label"), "vec_id", "left")
    norm = F.when(F.col("embedding").isNotNull(), features.vector_norm("embedding"))
    return out.select("vec_id", "label", (F.round(norm, 4) + F.lit(0.0)).alias("norm"))


@register(
    "e8_word_embeddings",
    rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s\x0b\x85\p{{Z}}]+') AS ws FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS word FROM w)
    SELECT doc_id, pos, word, CASE WHEN len(list_filter(regexp_extract_all(lower(word), '[\p{{L}}\p{{N}}_]{{2,}}'),
      lambda t: t NOT IN ({_STOPS}))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM e""",
)
def e8_word_embeddings(spark, sf_dir):
    """Vector of every word of every document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text").dropna()
    out = features.word_embeddings(docs, "text", keep=["doc_id"])
    return out.select("doc_id", "pos", "word", rounded(features.vector_norm("embedding")).alias("norm"))
