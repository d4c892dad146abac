"""Joins, coverage, collection and ordering over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonance.catalog.common import JOINED, POSTS, TEXTS, r, register, rounded
from resonance.functions import scalars as S
from resonance.operators import features, relational
from resonance.plans import flows, standins
from resonance.sources import scratch, tables

POST_COLUMNS = tables.POST_SCHEMA.fieldNames()


@register(
    "r1_attach_text",
    f"WITH {JOINED} SELECT post_id, post_url, impressions, {r('engagement_rate')} AS engagement_rate, post_text FROM joined",
)
def r1_attach_text(spark, sf_dir):
    return flows.posts_with_text(spark, sf_dir).select(
        "post_id", "post_url", "impressions", rounded("engagement_rate").alias("engagement_rate"), "post_text"
    )


@register(
    "r1_attach_repeated_texts",
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT concat('u/', CAST(o.o_custkey AS VARCHAR)) AS post_url, o.o_orderkey, o.o_orderpriority AS post_text,
      n.k IS NULL AS no_lines
    FROM orders o LEFT JOIN l n ON n.k = o.o_orderkey
    UNION ALL
    SELECT concat('u/', CAST(c.c_custkey AS VARCHAR)), NULL, NULL, NULL FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""",
)
def r1_attach_repeated_texts(spark, sf_dir):
    """Many texts per URL: every match is kept, and every post without one."""
    customers = standins.table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" u/"), F.col("c_custkey").cast("string"), F.lit("/")).alias("post_url")
    )
    lines = standins.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    orders = (
        standins.table(spark, sf_dir, "orders")
        .join(lines.withColumn("has", F.lit(True)), "o_orderkey", "left")
        .select(
            F.concat(F.lit("u/"), F.col("o_custkey").cast("string")).alias("post_url"),
            "o_orderkey",
            F.col("o_orderpriority").alias("post_text"),
            F.col("has").isNull().alias("no_lines"),
        )
    )
    return relational.attach_text(customers, orders)


@register(
    "r2_text_coverage",
    f"""WITH {JOINED} SELECT count(*) AS total_posts, count(post_text) AS with_text,
      count(*) - count(post_text) AS missing_text FROM joined""",
)
def r2_text_coverage(spark, sf_dir):
    return relational.text_coverage(flows.posts_with_text(spark, sf_dir))


_DONE = """done AS (SELECT p.post_url, t.post_text FROM posts p
      JOIN texts t ON rtrim(trim(p.post_url), '/') = t.post_url WHERE p.post_id % 2 = 0)"""


def _incoming_and_done(spark, sf_dir):
    """All documents arrive as texts under raw post URLs; the even labelled ones were collected."""
    incoming = (
        standins.posts(spark, sf_dir)
        .select("post_id", "post_url")
        .join(standins.table(spark, sf_dir, "documents").selectExpr("doc_id AS post_id", "text AS post_text"), "post_id")
        .select(F.when(F.col("post_id") % 11 != 0, F.col("post_url")).alias("post_url"),
                F.when(F.col("post_id") % 13 == 0, F.lit(" \n ")).otherwise(F.col("post_text")).alias("post_text"))
    )
    done = (
        flows.posts_with_text(spark, sf_dir)
        .where(F.col("post_text").isNotNull() & (F.col("post_id") % 2 == 0))
        .select("post_id", "post_text")
        .join(standins.posts(spark, sf_dir).select("post_id", "post_url"), "post_id")
        .select("post_url", "post_text")
    )
    return incoming, done


_INCOMING = """incoming AS (SELECT CASE WHEN p.post_id % 11 <> 0 THEN p.post_url END AS post_url,
      CASE WHEN p.post_id % 13 = 0 THEN chr(32) || chr(10) || chr(32) ELSE d.text END AS post_text
    FROM posts p JOIN documents d ON d.doc_id = p.post_id)"""
_TRIM = "trim(post_text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160))"


@register(
    "r3_not_yet_collected",
    f"""WITH {POSTS}, {TEXTS}, {_DONE} SELECT p.post_id, p.post_url FROM posts p
    WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.post_url = p.post_url)""",
)
def r3_not_yet_collected(spark, sf_dir):
    _, done = _incoming_and_done(spark, sf_dir)
    seen = relational.seen_urls(done)
    return standins.posts(spark, sf_dir).select("post_id", "post_url").join(seen, "post_url", "left_anti")


@register(
    "r10_done_urls",
    """SELECT DISTINCT concat('https://www.example.com/users/', CAST(user_id AS VARCHAR)) AS post_url FROM events""",
)
def r10_done_urls(spark, sf_dir):
    visits = standins.table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://www.example.com/users/"), F.col("user_id").cast("string")).alias("post_url")
    )
    return relational.seen_urls(visits)


@register(
    "s6_incremental_collection",
    f"""WITH {POSTS}, {TEXTS}, {_DONE}, {_INCOMING}
    SELECT post_url, post_text FROM done
    UNION ALL
    SELECT post_url, {_TRIM} FROM incoming i
    WHERE post_url IS NOT NULL AND {_TRIM} <> '' AND NOT EXISTS (SELECT 1 FROM done d WHERE d.post_url = i.post_url)""",
)
def s6_incremental_collection(spark, sf_dir):
    incoming, done = _incoming_and_done(spark, sf_dir)
    return relational.append_new_texts(incoming, done)


@register(
    "r4_drop_missing",
    f"""WITH {JOINED} SELECT post_id, post_text, {r('engagement_rate')} AS engagement_rate FROM joined
    WHERE post_text IS NOT NULL AND engagement_rate IS NOT NULL""",
)
def r4_drop_missing(spark, sf_dir):
    df = relational.drop_missing(flows.posts_with_text(spark, sf_dir), "post_text", "engagement_rate")
    return df.select("post_id", "post_text", rounded("engagement_rate").alias("engagement_rate"))


@register(
    "r5_engaged_with_text",
    f"WITH {JOINED} SELECT post_id, {r('engagement_rate')} AS engagement_rate FROM joined WHERE post_text IS NOT NULL AND engagement_rate > 0",
)
def r5_engaged_with_text(spark, sf_dir):
    df = relational.engaged(flows.posts_with_text(spark, sf_dir))
    return df.select("post_id", rounded("engagement_rate").alias("engagement_rate"))


@register(
    "r6_feature_projection",
    f"""WITH {POSTS} SELECT post_id, weekday, month, hour, impressions, reactions, comments, reposts, saves FROM posts""",
)
def r6_feature_projection(spark, sf_dir):
    return standins.posts(spark, sf_dir).select("post_id", *features.TUNING)


@register("r7_ranked_by_metric", f"WITH {POSTS} SELECT post_id, impressions FROM posts")
def r7_ranked_by_metric(spark, sf_dir):
    """All posts, most impressions first."""
    posts = standins.posts(spark, sf_dir).select("post_id", "impressions")
    return relational.ranked(posts, "impressions", "post_id")


_WORD_EFFECT = """words AS (SELECT l_shipdate AS d, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1),
    e AS (SELECT strftime(d, '%Y-%m-%d') AS keyword, x - (SELECT avg(x) FROM words) AS influence FROM words)"""


def _day_effects(spark, sf_dir):
    """A keyword table for ranking: each ship day and its price effect."""
    days = (
        standins.table(spark, sf_dir, "lineitem")
        .groupBy("l_shipdate")
        .agg(F.avg("l_extendedprice").alias("x"))
    )
    mean = days.agg(F.avg("x").alias("m")).scalar()
    return days.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("keyword"), (F.col("x") - mean).alias("influence")
    )


@register(
    "r7_ranked_by_size",
    f"WITH {_WORD_EFFECT} SELECT keyword, {r('influence', 4)} AS influence FROM e",
)
def r7_ranked_by_size(spark, sf_dir):
    ranked = relational.ranked(_day_effects(spark, sf_dir), "influence", "keyword", absolute=True)
    return ranked.select("keyword", rounded("influence", 4).alias("influence"))


@register(
    "r8_extremes",
    f"""WITH {_WORD_EFFECT}
    SELECT * FROM (SELECT keyword, {r('influence', 4)} AS influence, 'top' AS side FROM e ORDER BY e.influence DESC, keyword LIMIT 20)
    UNION ALL
    SELECT * FROM (SELECT keyword, {r('influence', 4)} AS influence, 'bottom' AS side FROM e ORDER BY e.influence, keyword LIMIT 20)""",
)
def r8_extremes(spark, sf_dir):
    out = relational.extremes(_day_effects(spark, sf_dir), "influence", 20)
    return out.select("keyword", rounded("influence", 4).alias("influence"), "side")


@register(
    "r9_append",
    f"""WITH {TEXTS} SELECT post_url, post_text FROM texts
    UNION ALL SELECT concat('https://www.example.com/items/', CAST(item_id AS VARCHAR)), text FROM benchmark""",
)
def r9_append(spark, sf_dir):
    more = standins.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("https://www.example.com/items/"), F.col("item_id").cast("string")).alias("post_url"),
        F.col("text").alias("post_text"),
    )
    return standins.texts(spark, sf_dir).unionByName(more)


@register(
    "r12_words_with_post_attributes",
    rf"""WITH {JOINED},
    w AS (SELECT post_id, impressions, weekday,
            regexp_extract_all(post_text, '[^\s\x0b\x85\p{{Z}}]+') AS ws FROM joined)
    SELECT post_id, impressions, weekday, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS word FROM w""",
)
def r12_words_with_post_attributes(spark, sf_dir):
    posts = flows.posts_with_text(spark, sf_dir)
    return features.exploded(posts, ["post_id", "impressions", "weekday"], S.words(F.col("post_text")), "word", "pos")


@register(
    "r12_all_words_with_post_attributes",
    rf"""WITH {POSTS},
    w AS (SELECT doc_id, impressions, weekday, regexp_extract_all(text, '[^\s\x0b\x85\p{{Z}}]+') AS ws
      FROM documents LEFT JOIN posts ON post_id = doc_id)
    SELECT doc_id, impressions, weekday, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS word FROM w""",
)
def r12_all_words_with_post_attributes(spark, sf_dir):
    """Every word of every document, labelled or not; a document without a post keeps nulls."""
    posts = standins.posts(spark, sf_dir).select(F.col("post_id").alias("doc_id"), "impressions", "weekday")
    docs = standins.documents(spark, sf_dir).select("doc_id", "text").join(posts, "doc_id", "left")
    return features.exploded(docs, ["doc_id", "impressions", "weekday"], S.words(F.col("text")), "word", "pos")


@register(
    "s10_preview",
    f"WITH {POSTS} SELECT post_id, post_url, impressions FROM posts ORDER BY post_id LIMIT 5",
)
def s10_preview(spark, sf_dir):
    return relational.preview(standins.posts(spark, sf_dir), "post_id").select("post_id", "post_url", "impressions")


_STORED = f"""SELECT post_url, strftime(post_date, '%Y-%m-%d %H:%M:%S') AS post_date, weekday, hour, impressions,
      {r('engagement_rate')} AS engagement_rate, post_text FROM joined"""


def _stored(spark, sf_dir, fmt):
    """Posts with text written to storage and read back under the declared schema."""
    schema = tables.POST_WITH_TEXT_SCHEMA
    df = flows.posts_with_text(spark, sf_dir)
    df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    path = scratch.scratch_path(spark, f"posts-{fmt}")
    tables.write_table(df, path, fmt)
    back = tables.read_posts(spark, path, fmt, with_text=True)
    return back.select(
        "post_url",
        F.date_format("post_date", "yyyy-MM-dd HH:mm:ss").alias("post_date"),
        "weekday",
        "hour",
        "impressions",
        rounded("engagement_rate").alias("engagement_rate"),
        "post_text",
    )


@register("s3_csv_write_and_read", f"WITH {JOINED} {_STORED}")
def s3_csv_write_and_read(spark, sf_dir):
    return _stored(spark, sf_dir, "csv")


@register("s5_parquet_write_and_read", f"WITH {JOINED} {_STORED}")
def s5_parquet_write_and_read(spark, sf_dir):
    return _stored(spark, sf_dir, "parquet")


@register("s8_required_columns", f"WITH {JOINED} SELECT count(*) AS n_rows FROM joined")
def s8_required_columns(spark, sf_dir):
    df = tables.require_columns(flows.posts_with_text(spark, sf_dir), "post_url", "post_text", "engagement_rate")
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
