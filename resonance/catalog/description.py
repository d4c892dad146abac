"""Descriptive statistics of posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonance.catalog.common import JOINED, POSTS, r, register, rounded
from resonance.operators import describe
from resonance.plans import flows, standins

NUMERIC = ["weekday", "month", "year", "hour", *standins.METRICS, "engagement_rate"]
CORRELATED = describe.CORRELATED


def _describe_sql() -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS "count", {r(f'avg({c})')} AS mean,
        {r(f'stddev_samp({c})')} AS std, {r(f'CAST(min({c}) AS DOUBLE)')} AS "min",
        {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50,
        {r(f'quantile_cont({c}, 0.75)')} AS p75, {r(f'CAST(max({c}) AS DOUBLE)')} AS "max" FROM posts"""
        for c in NUMERIC
    ]
    return f"WITH {POSTS} " + " UNION ALL ".join(parts)


@register("a1_numeric_summary", _describe_sql())
def a1_numeric_summary(spark, sf_dir):
    out = describe.describe_numeric(standins.posts(spark, sf_dir), NUMERIC)
    return out.select("column", "count", *[rounded(c).alias(c) for c in out.columns[2:]])


def _histogram_sql(c: str) -> str:
    return f"""WITH {POSTS},
    s AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi
          FROM (SELECT CAST(min({c}) AS DOUBLE) AS a, CAST(max({c}) AS DOUBLE) AS b FROM posts)),
    h AS (SELECT CAST(least(floor(({c} - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n
          FROM posts, s GROUP BY 1)
    SELECT CAST(g.i AS INTEGER) AS bin, {r('lo + g.i * ((hi - lo) / 30)')} AS left_edge,
      {r('lo + (g.i + 1) * ((hi - lo) / 30)')} AS right_edge, coalesce(h.n, 0) AS n
    FROM range(30) AS g(i) CROSS JOIN s LEFT JOIN h ON h.bin = g.i"""


def _histogram(spark, sf_dir, c):
    h = describe.histogram(standins.posts(spark, sf_dir), c, 30)
    return h.select("bin", rounded("left_edge").alias("left_edge"), rounded("right_edge").alias("right_edge"), "n")


@register("a2_histogram_impressions", _histogram_sql("impressions"))
def a2_histogram_impressions(spark, sf_dir):
    return _histogram(spark, sf_dir, "impressions")


@register("a2_histogram_engagement_rate", _histogram_sql("engagement_rate"))
def a2_histogram_engagement_rate(spark, sf_dir):
    return _histogram(spark, sf_dir, "engagement_rate")


def _kde_sql(c: str) -> str:
    return f"""WITH {POSTS},
    s AS (SELECT count({c}) AS n, stddev_samp({c}) * pow(count({c}), -0.2) AS h,
            CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM posts),
    v AS (SELECT CAST({c} AS DOUBLE) AS v, count(*) AS w FROM posts GROUP BY 1),
    k AS (SELECT g.i AS grid, s.lo + g.i * (s.hi - s.lo) / 199 AS x,
            w * exp(-0.5 * pow(((s.lo + g.i * (s.hi - s.lo) / 199) - v) / h, 2)) / (h * sqrt(2 * pi()))
              * (hi - lo) / 30 AS k
          FROM range(200) AS g(i) CROSS JOIN s CROSS JOIN v)
    SELECT CAST(grid AS INTEGER) AS grid, {r('min(x)')} AS x, {r('sum(k)')} AS density FROM k GROUP BY grid"""


def _kde(spark, sf_dir, c):
    k = describe.kde(standins.posts(spark, sf_dir), c)
    return k.select("grid", rounded("x").alias("x"), rounded("density").alias("density"))


@register("a3_density_impressions", _kde_sql("impressions"))
def a3_density_impressions(spark, sf_dir):
    return _kde(spark, sf_dir, "impressions")


@register("a3_density_engagement_rate", _kde_sql("engagement_rate"))
def a3_density_engagement_rate(spark, sf_dir):
    return _kde(spark, sf_dir, "engagement_rate")


_CORR_SQL = f"WITH {POSTS} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM posts" for a in CORRELATED for b in CORRELATED
)


@register("a4_correlation_matrix", _CORR_SQL)
def a4_correlation_matrix(spark, sf_dir):
    return describe.correlation_long(standins.posts(spark, sf_dir)).select("a", "b", rounded("r").alias("r"))


@register(
    "a5_scatter_impressions_reactions",
    f"WITH {POSTS} SELECT impressions, reactions, count(*) AS n FROM posts GROUP BY 1, 2",
)
def a5_scatter_impressions_reactions(spark, sf_dir):
    return describe.scatter_points(standins.posts(spark, sf_dir), "impressions", "reactions")


@register(
    "a5_scatter_density",
    f"""WITH {POSTS}, s AS (SELECT min(impressions) AS x0, max(impressions) AS x1, min(engagement_rate) AS y0,
      max(engagement_rate) AS y1 FROM posts)
    SELECT CAST(least(floor((CAST(impressions AS DOUBLE) - x0) * 30 / (x1 - x0)), 29) AS INTEGER) AS x_bin,
      CAST(least(floor((engagement_rate - y0) * 30 / (y1 - y0)), 29) AS INTEGER) AS y_bin, count(*) AS n
    FROM posts, s GROUP BY 1, 2""",
)
def a5_scatter_density(spark, sf_dir):
    return describe.scatter_density(standins.posts(spark, sf_dir), "impressions", "engagement_rate")


def _box_sql(cte: str, source: str, where: str = "TRUE") -> str:
    return f"""WITH {cte},
    q AS (SELECT weekday, quantile_cont(engagement_rate, 0.25) AS q1, quantile_cont(engagement_rate, 0.5) AS median,
            quantile_cont(engagement_rate, 0.75) AS q3 FROM {source} WHERE {where} GROUP BY weekday),
    b AS (SELECT p.weekday, q1, median, q3, engagement_rate AS v,
            engagement_rate BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM {source} p JOIN q ON q.weekday = p.weekday WHERE {where})
    SELECT weekday, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3, count(*) AS n,
      {r('min(CASE WHEN inside THEN v END)')} AS whisker_low, {r('max(CASE WHEN inside THEN v END)')} AS whisker_high,
      count(CASE WHEN NOT inside THEN 1 END) AS outliers
    FROM b GROUP BY weekday, b.q1, b.median, b.q3"""


def _box(df):
    return df.select(
        "weekday",
        *[rounded(c).alias(c) for c in ("q1", "median", "q3")],
        "n",
        *[rounded(c).alias(c) for c in ("whisker_low", "whisker_high")],
        "outliers",
    )


@register("a6_box_by_weekday", _box_sql(POSTS, "posts"))
def a6_box_by_weekday(spark, sf_dir):
    return _box(describe.box_stats(standins.posts(spark, sf_dir), "weekday", "engagement_rate", groups=7))


@register("a6_engagement_by_weekday_with_text", _box_sql(JOINED, "joined", "post_text IS NOT NULL"))
def a6_engagement_by_weekday_with_text(spark, sf_dir):
    return _box(flows.engagement_by_weekday(spark, sf_dir))


@register(
    "a7_stage_shapes",
    f"""WITH {JOINED}
    SELECT 'posts' AS stage, (SELECT count(*) FROM posts) AS n_rows, 13 AS n_columns
    UNION ALL SELECT 'texts', (SELECT count(*) FROM texts), 2
    UNION ALL SELECT 'joined', (SELECT count(*) FROM joined), 14
    UNION ALL SELECT 'with_text', (SELECT count(post_text) FROM joined), 14""",
)
def a7_stage_shapes(spark, sf_dir):
    joined = flows.posts_with_text(spark, sf_dir)
    stages = {
        "posts": standins.posts(spark, sf_dir),
        "texts": standins.texts(spark, sf_dir),
        "joined": joined,
        "with_text": joined.dropna(subset=["post_text"]),
    }
    out = None
    for name, df in stages.items():
        one = describe.shape(df).select(F.lit(name).alias("stage"), "n_rows", "n_columns")
        out = one if out is None else out.unionByName(one)
    return out
