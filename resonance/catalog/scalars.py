"""Scalar rules over whole tables, on messy values derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonance.catalog.common import JOINED, POSTS, TYPED, r, register, rounded
from resonance.functions import scalars as S
from resonance.operators import relational
from resonance.plans import flows, standins
from resonance.sources import tables


def _events(spark, sf_dir):
    return standins.table(spark, sf_dir, "events")


_NUMBER_TEXT = """CASE CAST(event_id % 12 AS INTEGER)
      WHEN 0 THEN concat(CAST(event_id AS {s}), ',', '250') WHEN 1 THEN concat(' ', CAST(event_id AS {s}), ' ')
      WHEN 2 THEN concat(CAST(event_id AS {s}), '.7') WHEN 3 THEN concat('-', CAST(event_id AS {s}), '.9')
      WHEN 4 THEN '1e3' WHEN 5 THEN '' WHEN 6 THEN concat(CAST(event_id AS {s}), '%') WHEN 7 THEN 'nan'
      WHEN 8 THEN concat(CAST(event_id AS {s}), 'd') WHEN 9 THEN concat('1_', CAST(event_id AS {s}))
      WHEN 10 THEN NULL ELSE props END"""


@register(
    "f1_parse_int",
    f"""WITH t AS (SELECT event_id, {_NUMBER_TEXT.format(s='VARCHAR')} AS raw FROM events),
    s AS (SELECT event_id, regexp_replace(trim(replace(raw, ',', '')), '([0-9])_([0-9])', '\\1\\2', 'g') AS v FROM t),
    n AS (SELECT event_id, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
            THEN v END AS v FROM s)
    SELECT event_id, CAST(coalesce(trunc(TRY_CAST(v AS DOUBLE)), 0) AS BIGINT) AS parsed FROM n""",
)
def f1_parse_int(spark, sf_dir):
    raw = F.expr(_NUMBER_TEXT.format(s="STRING"))
    return _events(spark, sf_dir).select("event_id", S.parse_int(raw).alias("parsed"))


_LINK_TEXT = """CASE CAST(page_id % 6 AS INTEGER) WHEN 0 THEN url
      WHEN 1 THEN concat('see HTTPS://WWW.LinkedIn.com/posts/', CAST(page_id AS {s}))
      WHEN 2 THEN concat('https://linkedin.com/in/', CAST(page_id AS {s}))
      WHEN 3 THEN concat('https://de.linkedin.com/in/', CAST(page_id AS {s}))
      WHEN 4 THEN NULL ELSE html END"""


@register(
    "f2_is_post_url",
    f"""WITH t AS (SELECT page_id, {_LINK_TEXT.format(s='VARCHAR')} AS link FROM pages)
    SELECT page_id, coalesce(regexp_matches(link, '(?i)https?://(?:www\\.)?linkedin\\.com'), false) AS is_post
    FROM t""",
)
def f2_is_post_url(spark, sf_dir):
    link = F.expr(_LINK_TEXT.format(s="STRING"))
    return standins.table(spark, sf_dir, "pages").select("page_id", S.is_post_url(link).alias("is_post"))


@register(
    "f3_normalize_key",
    """SELECT l_orderkey, l_linenumber, coalesce(lower(trim(CASE WHEN l_linenumber = 3 THEN NULL
      ELSE concat('  ', l_returnflag, ' Post URL ', l_linestatus, ' ') END)), '') AS key FROM lineitem""",
)
def f3_normalize_key(spark, sf_dir):
    label = F.when(
        F.col("l_linenumber") != 3, F.concat(F.lit("  "), "l_returnflag", F.lit(" Post URL "), "l_linestatus", F.lit(" "))
    )
    return standins.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", S.normalize_key(label).alias("key")
    )


@register("f4_url_key", f"WITH {POSTS} SELECT post_id, rtrim(trim(post_url), '/') AS url_key FROM posts")
def f4_url_key(spark, sf_dir):
    return standins.posts(spark, sf_dir).select("post_id", S.url_key(F.col("post_url")).alias("url_key"))


@register(
    "f5_first_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS first_date FROM orders""",
)
def f5_first_date(spark, sf_dir):
    """Dates written in several ways, some only under the second label, some nowhere."""
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 5
    first = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "M/d/yyyy"))
        .when(kind == 2, F.date_format(day, "MMM d, yyyy"))
        .otherwise(F.lit("soon"))
    )
    second = F.when(kind == 3, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("n/a"))
    read = standins.table(spark, sf_dir, "orders").select(
        "o_orderkey", S.first_date(first, second).alias("d")
    )
    return read.select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("first_date"))


@register(
    "f6_date_parts",
    """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday,
      CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
)
def f6_date_parts(spark, sf_dir):
    parts = S.date_parts(F.col("o_orderdate"))
    return standins.table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@register(
    "f7_post_hour",
    """SELECT event_id, CAST(CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN CASE WHEN hour(ts) % 12 = 0 THEN 12
        ELSE hour(ts) % 12 END WHEN 4 THEN -1 ELSE hour(ts) END AS INTEGER) AS hour FROM events""",
)
def f7_post_hour(spark, sf_dir):
    """A text time gives its leading number, a blank one the date's hour, an unreadable one none."""
    ts, kind = F.col("ts"), F.col("event_id") % 6
    time = (
        F.when(kind == 0, F.date_format(ts, "h:mm a"))
        .when(kind == 1, F.date_format(ts, "H:mm"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd HH:mm"))
        .when(kind == 3, F.lit("  "))
        .when(kind == 4, F.lit("at noon"))
    )
    return _events(spark, sf_dir).select(
        "event_id", F.coalesce(S.post_hour(time, ts), F.lit(-1)).alias("hour")
    )


@register(
    "f8_engagement_rate",
    f"WITH {POSTS} SELECT post_id, {r('engagement_rate')} AS engagement_rate FROM posts",
)
def f8_engagement_rate(spark, sf_dir):
    return standins.posts(spark, sf_dir).select("post_id", rounded("engagement_rate").alias("engagement_rate"))


@register(
    "f9_fill_numeric",
    f"""WITH {POSTS} SELECT post_id, coalesce(CASE WHEN impressions > 2 THEN impressions END, 0) AS impressions,
      coalesce(CASE WHEN weekday <> 0 THEN weekday END, 0) AS weekday FROM posts""",
)
def f9_fill_numeric(spark, sf_dir):
    gaps = standins.posts(spark, sf_dir).select(
        "post_id",
        F.when(F.col("impressions") > 2, F.col("impressions")).alias("impressions"),
        F.when(F.col("weekday") != 0, F.col("weekday")).alias("weekday"),
    )
    return relational.fill_numeric(gaps, ["impressions", "weekday"])


@register(
    "f10_fill_text",
    f"WITH {JOINED} SELECT post_id, coalesce(post_text, '') AS post_text FROM joined",
)
def f10_fill_text(spark, sf_dir):
    return relational.fill_text(flows.posts_with_text(spark, sf_dir)).select("post_id", "post_text")


@register(
    "f11_known_post_type",
    f"""WITH {TYPED} SELECT post_id, CASE WHEN post_type IN ('Text','Image','Video','Poll','Link','Article','Document')
      THEN post_type ELSE 'Text' END AS post_type FROM kinds""",
)
def f11_known_post_type(spark, sf_dir):
    return standins.post_types(spark, sf_dir).select("post_id", S.known_or(F.col("post_type")).alias("post_type"))


@register(
    "f12_ensure_column",
    f"WITH {JOINED} SELECT post_id, weekday, 'Text' AS post_type FROM joined",
)
def f12_ensure_column(spark, sf_dir):
    df = tables.ensure_column(flows.posts_with_text(spark, sf_dir), "post_type", "Text")
    return tables.ensure_column(df, "weekday", 0).select("post_id", "weekday", "post_type")


@register(
    "f13_text_column_choice",
    """SELECT 'documents' AS source, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents""",
)
def f13_text_column_choice(spark, sf_dir):
    docs = standins.table(spark, sf_dir, "documents")
    text = tables.text_column(docs)
    return docs.agg(F.count(text).alias("n_rows"), F.sum(F.length(text)).alias("n_chars")).select(
        F.lit("documents").alias("source"), "n_rows", "n_chars"
    )


@register(
    "f14_existing_features",
    f"WITH {JOINED} SELECT post_id, impressions, reactions, comments, reposts, saves FROM joined",
)
def f14_existing_features(spark, sf_dir):
    df = flows.posts_with_text(spark, sf_dir)
    wanted = ["impressions", "reactions", "comments", "reposts", "saves", "likes"]
    return df.select("post_id", *tables.existing(df, wanted))


@register(
    "f15_alias_lookup",
    f"""WITH {POSTS} SELECT post_id,
      CASE CAST(post_id % 3 AS INTEGER) WHEN 0 THEN post_url WHEN 1 THEN concat('b', post_url) ELSE concat('c', post_url)
        END AS url,
      coalesce(CASE WHEN post_id % 4 = 0 THEN impressions WHEN post_id % 4 = 1 THEN NULL ELSE saves END, -1) AS views
    FROM posts""",
)
def f15_alias_lookup(spark, sf_dir):
    """First non-empty value for URLs; first label present, even if empty, for views."""
    p, n = standins.posts(spark, sf_dir), F.col("post_id")
    url = S.first_truthy(
        F.when(n % 3 == 0, F.col("post_url")).otherwise(""),
        F.when(n % 3 == 1, F.concat(F.lit("b"), "post_url")),
        F.concat(F.lit("c"), "post_url"),
    )
    views = F.create_map(F.lit("views"), F.col("saves"))
    full = F.map_concat(F.create_map(F.lit("impressions"), F.col("impressions")), views)
    hollow = F.map_concat(F.create_map(F.lit("impressions"), F.lit(None).cast("bigint")), views)
    entries = F.when(n % 4 == 0, full).when(n % 4 == 1, hollow).otherwise(views)
    return p.select(
        "post_id",
        url.alias("url"),
        F.coalesce(S.first_present(entries, "impressions", "views"), F.lit(-1)).cast("bigint").alias("views"),
    )


@register(
    "f16_word_count",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s\x0b\x85\p{Z}]+'))
      AS INTEGER) AS n_words FROM documents""",
)
def f16_word_count(spark, sf_dir):
    return standins.table(spark, sf_dir, "documents").select("doc_id", S.word_count(F.col("text")).alias("n_words"))


@register(
    "f17_url_as_text",
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS url FROM documents",
)
def f17_url_as_text(spark, sf_dir):
    """A missing URL stays missing when the column becomes text."""
    n = F.col("doc_id")
    return standins.table(spark, sf_dir, "documents").select("doc_id", F.when(n % 7 != 0, n).cast("string").alias("url"))


_SCORES = "CAST(length(text) AS DOUBLE) / (turn + 1)"
_SHADES = f"""WITH s AS (SELECT conv_id, turn, {_SCORES} AS score FROM conversations),
    c AS (SELECT conv_id, turn, score - avg(score) OVER (PARTITION BY conv_id) AS c FROM s),
    m AS (SELECT *, max(abs(c)) OVER (PARTITION BY conv_id) AS m FROM c)
    SELECT conv_id, turn, {{cols}} FROM m"""


def _shaded(spark, sf_dir):
    scored = standins.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.length("text").cast("double") / (F.col("turn") + 1)).alias("score")
    )
    return relational.influence_shades(scored, "conv_id", "score")


@register(
    "f18_influence_shades",
    _SHADES.format(cols=f"""CASE WHEN c > 0 THEN 'green' ELSE 'red' END AS colour,
      {r('0.25 + 0.75 * abs(c) / coalesce(nullif(m, 0), 1)')} AS opacity"""),
)
def f18_influence_shades(spark, sf_dir):
    return _shaded(spark, sf_dir).select("conv_id", "turn", "colour", rounded("opacity").alias("opacity"))


@register("r11_contributions", _SHADES.format(cols=f"{r('c')} AS contribution"))
def r11_contributions(spark, sf_dir):
    return _shaded(spark, sf_dir).select("conv_id", "turn", rounded("contribution").alias("contribution"))


@register(
    "f19_scorable_texts",
    r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^\s\x0b\x85\p{Z}]+'))
        AS n FROM documents)
    SELECT doc_id, n > 0 AS scorable, n >= 3 AS explainable FROM w""",
)
def f19_scorable_texts(spark, sf_dir):
    text = F.col("text")
    return standins.table(spark, sf_dir, "documents").select(
        "doc_id", S.not_blank(text).alias("scorable"), (S.word_count(text) >= 3).alias("explainable")
    )
