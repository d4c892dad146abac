"""Flows from raw tables to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonance.functions import scalars as S
from resonance.operators import describe, extract, relational
from resonance.plans import standins
from resonance.sources import workbook
from resonance.sources.scratch import written


def consolidate_workbooks(
    spark: SparkSession,
    folder: str,
    pattern: str = workbook.FILE_PATTERN,
    host: str = S.POST_HOST,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Folder of workbooks to ``(posts, unreadable files)``.

    The files are unpacked once; their cells are kept as a Parquet table, as
    extraction looks at them in several ways.
    """
    cells = written(workbook.read_sheet_cells(spark, folder, pattern), "cells")
    good, bad = workbook.split_bad_files(cells)
    return extract.consolidate(good, host, **options), bad


def posts_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in posts joined to their collected texts."""
    return relational.attach_text(standins.posts(spark, sf_dir), standins.texts(spark, sf_dir))


def scoring_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with text and post type, as the scoring models read them."""
    return posts_with_text(spark, sf_dir).join(standins.post_types(spark, sf_dir), "post_id", "left")


def engagement_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box statistics of the engagement rate of posts with a text, by weekday."""
    with_text = posts_with_text(spark, sf_dir).where(F.col("post_text").isNotNull())
    return describe.box_stats(with_text, "weekday", "engagement_rate", groups=7)
