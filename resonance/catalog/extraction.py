"""Sheet extraction: cells derived from posts must give the posts back."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonance.catalog.common import CELLS, POSTS, r, register, rounded
from resonance.operators import extract, relational
from resonance.plans import flows, standins
from resonance.sources import scratch, workbook
from resonance.sources.workbook_sink import write_workbooks

HOST = standins.HOST
KEYS = {3: "impressions", 4: "reactions", 5: "comments", 6: "reposts", 7: "saves"}
LABELS = ("post url", "post date", "post publish time", *KEYS.values())
KEY_LIST = ", ".join(f"'{k}'" for k in LABELS)


def cells(spark, sf_dir):
    return standins.sheet_cells(spark, sf_dir)


def stored_cells(spark, sf_dir):
    """The cells written once, as the flow over workbooks does: extraction looks at them in four ways."""
    return scratch.written(cells(spark, sf_dir), "cells")


@register(
    "x1_header_like_sheets",
    f"""WITH {CELLS} SELECT file, bool_or(regexp_matches(lower(value),
      'post url|post date|impressions|reactions|comments')) AS header_like
    FROM cells WHERE "row" = 0 GROUP BY file""",
)
def x1_header_like_sheets(spark, sf_dir):
    return extract.header_like(cells(spark, sf_dir))


@register(
    "x2_header_entries",
    f"""WITH {CELLS},
    h AS (SELECT file, "col" AS c, lower(trim(value)) AS key FROM cells WHERE "row" = 0),
    v AS (SELECT file, "col" AS c, arg_min(value, "row") AS value FROM cells WHERE "row" > 0 GROUP BY 1, 2)
    SELECT h.file, h.key, v.value FROM h LEFT JOIN v ON h.file = v.file AND h.c = v.c WHERE h.key IN ({KEY_LIST})""",
)
def x2_header_entries(spark, sf_dir):
    return extract.header_entries(cells(spark, sf_dir)).select("file", "key", "value")


@register(
    "x3_column_entries",
    f"""WITH {CELLS},
    b AS (SELECT a.file, a."row" AS rw, lower(trim(a.value)) AS key, b.value FROM cells a
          LEFT JOIN cells b ON a.file = b.file AND a."row" = b."row" AND b."col" = 1 WHERE a."col" = 0)
    SELECT file, key, arg_min(value, rw) AS value FROM b WHERE key IN ({KEY_LIST}) GROUP BY file, key""",
)
def x3_column_entries(spark, sf_dir):
    return extract.column_entries(cells(spark, sf_dir)).select("file", "key", "value")


_URL = "regexp_matches(value, '(?i)https?://(?:www\\.)?www\\.example\\.com')"


@register(
    "x4_neighbour_urls",
    f"""WITH {CELLS},
    d AS (SELECT * FROM (VALUES (0, 1, 0), (1, 0, 1), (1, 1, 2)) AS t(dr, dc, rk)),
    hit AS (SELECT k.file, u.value, k."row" * 1000 + k."col" * 10 + d.rk AS pos
            FROM cells k CROSS JOIN d
            JOIN cells u ON u.file = k.file AND u."row" = k."row" + d.dr AND u."col" = k."col" + d.dc
            WHERE contains(lower(k.value), 'url') AND {_URL.replace('value', 'u.value')})
    SELECT file, trim(arg_min(value, pos)) AS url FROM hit GROUP BY file""",
)
def x4_neighbour_urls(spark, sf_dir):
    return extract.neighbour_urls(cells(spark, sf_dir), HOST)


@register(
    "x5_any_url",
    f"""WITH {CELLS} SELECT file, trim(arg_min(value, "row" * 1000 + "col")) AS url
    FROM cells WHERE {_URL} GROUP BY file""",
)
def x5_any_url(spark, sf_dir):
    return extract.any_url(cells(spark, sf_dir), HOST)


@register(
    "x6_metrics_map",
    f"""WITH {POSTS}
    SELECT CAST(post_id AS VARCHAR) AS file, post_id % 3 <> 1 AS url_by_position, k.key,
      CASE k.key WHEN 'post url' THEN CASE WHEN post_id % 3 = 1 THEN post_url ELSE trim(post_url) END
        WHEN 'post date' THEN CAST(CAST(post_date AS DATE) AS VARCHAR)
        WHEN 'post publish time' THEN concat(CAST(hour AS VARCHAR), ':00')
        WHEN 'impressions' THEN CAST(impressions AS VARCHAR) WHEN 'reactions' THEN CAST(reactions AS VARCHAR)
        WHEN 'comments' THEN CAST(comments AS VARCHAR) WHEN 'reposts' THEN CAST(reposts AS VARCHAR)
        ELSE CAST(saves AS VARCHAR) END AS value
    FROM posts CROSS JOIN (SELECT unnest([{KEY_LIST}]) AS key) k""",
)
def x6_metrics_map(spark, sf_dir):
    metrics = extract.extract_metrics(stored_cells(spark, sf_dir), HOST)
    return metrics.select("file", "url_by_position", F.explode("entries").alias("key", "e")).select(
        "file", "url_by_position", "key", F.col("e.value").alias("value")
    )


_POSTS_BACK = f"""WITH {POSTS}
    SELECT CAST(post_id AS VARCHAR) AS file, trim(post_url) AS post_url,
      strftime(CAST(post_date AS DATE), '%Y-%m-%d %H:%M:%S') AS post_date, weekday, month, year, hour,
      impressions, reactions, comments, reposts, saves, {r('engagement_rate')} AS engagement_rate FROM posts"""


def _readable(posts):
    return posts.withColumns(
        {
            "post_url": F.trim("post_url"),
            "post_date": F.date_format("post_date", "yyyy-MM-dd HH:mm:ss"),
            "engagement_rate": rounded("engagement_rate"),
        }
    )


@register("x7_posts_from_sheets", _POSTS_BACK)
def x7_posts_from_sheets(spark, sf_dir):
    return _readable(extract.consolidate(stored_cells(spark, sf_dir), HOST))


@register("x8_consolidated_total", f"""WITH {POSTS}
    SELECT count(*) AS files, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(saves) AS BIGINT) AS saves,
      {r('sum(engagement_rate)')} AS engagement_rate FROM posts""")
def x8_consolidated_total(spark, sf_dir):
    """Halves of the cell table read apart and appended give the whole."""
    all_cells = stored_cells(spark, sf_dir)
    odd = F.col("file").cast("bigint") % 2 == 1
    parts = [extract.consolidate(all_cells.where(p), HOST) for p in (odd, ~odd)]
    return parts[0].unionByName(parts[1]).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("impressions").alias("impressions"),
        F.sum("saves").alias("saves"),
        rounded(F.sum("engagement_rate")).alias("engagement_rate"),
    )


@register(
    "s9_url_found_report",
    f"""WITH {POSTS} SELECT CASE WHEN post_url IS NOT NULL THEN 'FOUND' ELSE 'MISSING' END AS status,
      count(*) AS records FROM posts GROUP BY 1""",
)
def s9_url_found_report(spark, sf_dir):
    return relational.url_coverage(extract.consolidate(cells(spark, sf_dir), HOST))


def _workbooks(spark, sf_dir):
    """Every post as a workbook file in the shared scratch folder."""
    folder = scratch.scratch_path(spark, "workbooks")
    write_workbooks(cells(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    return folder


@register(
    "s2_workbook_cells",
    f"""WITH {CELLS} SELECT concat('PostAnalytics_', file, '.xlsx') AS file, CAST("row" AS INTEGER) AS "row",
      CAST("col" AS INTEGER) AS "col", value FROM cells""",
)
def s2_workbook_cells(spark, sf_dir):
    """Cells of all workbooks of a folder, as they were written."""
    read = scratch.written(workbook.read_sheet_cells(spark, _workbooks(spark, sf_dir)), "cells")
    good, _ = workbook.split_bad_files(read)
    return good.select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "row", "col", "value")


@register(
    "s1_workbooks_by_pattern",
    f"""WITH {POSTS} SELECT concat('PostAnalytics_', CAST(post_id AS VARCHAR), '.xlsx') AS file, 16 AS cells
    FROM posts WHERE CAST(post_id AS VARCHAR) LIKE '%7'""",
)
def s1_workbooks_by_pattern(spark, sf_dir):
    """Only the files whose name matches the pattern are read."""
    read = workbook.read_sheet_cells(spark, _workbooks(spark, sf_dir), pattern="PostAnalytics_*7.xlsx")
    return read.groupBy(F.regexp_extract("file", "[^/]+$", 0).alias("file")).agg(
        F.count(F.lit(1)).cast("int").alias("cells")
    )


@register("s4_posts_from_workbooks", _POSTS_BACK.replace("CAST(post_id AS VARCHAR) AS file,", ""))
def s4_posts_from_workbooks(spark, sf_dir):
    """Workbooks to posts; texts that are no workbooks lie in the same folder and are reported, not read."""
    folder = _workbooks(spark, sf_dir)
    standins.texts(spark, sf_dir).select("post_text").write.mode("overwrite").text(f"{folder}/notes")
    posts, _ = flows.consolidate_workbooks(spark, folder, pattern="*", host=HOST)
    return _readable(posts).drop("file")
