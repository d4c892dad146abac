"""Registry of queries over the given tables, and SQL shared by their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its check SQL if any."""

    def wrap(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round so that both engines' summation orders agree; no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`rounded`."""
    half = 0.5 * 10**-digits
    return f"CASE WHEN abs({expr}) < {half:.12f} THEN 0.0 ELSE round({expr}, {digits}) END"


POSTS = """
posts AS (
  SELECT p.*,
    concat(' https://www.example.com/posts/', CAST(post_id AS VARCHAR),
      CASE WHEN post_id % 3 = 0 THEN '//' WHEN post_id % 3 = 1 THEN '/' ELSE '' END) AS post_url,
    CASE WHEN impressions > 0 THEN CAST(reactions + comments + reposts AS DOUBLE) / impressions ELSE 0.0 END
      AS engagement_rate,
    CAST(isodow(post_date) - 1 AS INTEGER) AS weekday, CAST(month(post_date) AS INTEGER) AS month,
    CAST(year(post_date) AS INTEGER) AS year, CAST(hour(post_date) AS INTEGER) AS hour
  FROM (
    SELECT CAST(floor(CAST(event_id AS DOUBLE) * (SELECT count(*) FROM documents) / (SELECT count(*) FROM events))
        AS BIGINT) AS post_id,
      min(ts) AS post_date,
      count(CASE WHEN event_type = 'view' THEN 1 END) AS impressions,
      count(CASE WHEN event_type = 'click' THEN 1 END) AS reactions,
      count(CASE WHEN event_type = 'signup' THEN 1 END) AS comments,
      count(CASE WHEN event_type = 'purchase' THEN 1 END) AS reposts,
      count(CASE WHEN event_type = 'error' THEN 1 END) AS saves
    FROM events GROUP BY 1) p)"""

TEXTS = """
texts AS (
  SELECT concat('https://www.example.com/posts/', CAST(d.doc_id AS VARCHAR)) AS post_url, d.text AS post_text
  FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))"""

JOINED = POSTS + "," + TEXTS + """,
joined AS (
  SELECT p.* EXCLUDE (post_url), rtrim(trim(p.post_url), '/') AS post_url, t.post_text
  FROM posts p LEFT JOIN texts t ON rtrim(trim(p.post_url), '/') = rtrim(trim(t.post_url), '/'))"""

TYPED = JOINED + """,
kinds AS (
  SELECT doc_id AS post_id,
    CASE CAST(substr(source, 4) AS INTEGER) % 9 WHEN 0 THEN 'Text' WHEN 1 THEN 'Image' WHEN 2 THEN 'Video'
      WHEN 3 THEN 'Poll' WHEN 4 THEN 'Link' WHEN 5 THEN 'Article' WHEN 6 THEN 'Document' WHEN 7 THEN 'Reel' END
      AS post_type
  FROM documents)"""

CELLS = POSTS + """,
cells AS (
  SELECT file, CASE WHEN layout = 1 THEN is_val ELSE k END AS "row", CASE WHEN layout = 1 THEN k ELSE is_val END AS "col",
    v AS value
  FROM (
    SELECT CAST(post_id AS VARCHAR) AS file, post_id % 3 AS layout, k, is_val,
      CASE WHEN is_val = 0 THEN CASE k WHEN 0 THEN 'Post URL' WHEN 1 THEN 'Post Date' WHEN 2 THEN 'Post Publish Time'
             WHEN 3 THEN 'Impressions' WHEN 4 THEN ' reactions ' WHEN 5 THEN 'COMMENTS' WHEN 6 THEN 'Reposts'
             ELSE 'Saves' END
           ELSE CASE k WHEN 0 THEN post_url WHEN 1 THEN CAST(CAST(post_date AS DATE) AS VARCHAR)
             WHEN 2 THEN concat(CAST(hour(post_date) AS VARCHAR), ':00') WHEN 3 THEN CAST(impressions AS VARCHAR)
             WHEN 4 THEN CAST(reactions AS VARCHAR) WHEN 5 THEN CAST(comments AS VARCHAR)
             WHEN 6 THEN CAST(reposts AS VARCHAR) ELSE CAST(saves AS VARCHAR) END END AS v
    FROM posts CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) AS kk(k)
               CROSS JOIN (VALUES (0),(1)) AS vv(is_val)) c)"""
