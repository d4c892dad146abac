"""Posts, texts and sheet cells derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonance.functions import scalars as S

# Fixed values of the stand-in data.
HOST = "www.example.com"
METRIC_OF_EVENT = {
    "impressions": "view",
    "reactions": "click",
    "comments": "signup",
    "reposts": "purchase",
    "saves": "error",
}
METRICS = list(METRIC_OF_EVENT)
SHEET_LABELS = (
    "Post URL",
    "Post Date",
    "Post Publish Time",
    "Impressions",
    " reactions ",
    "COMMENTS",
    "Reposts",
    "Saves",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, dealt to as many pieces as the session shuffles into.

    Work on texts is heavy per row, and a file with one row group is one task.
    """
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "documents").repartition(pieces, "doc_id")


def row_count(df: DataFrame) -> Column:
    """Row count of a table as a scalar subquery (answered from file footers)."""
    return df.select(F.count(F.lit(1)).alias("n")).scalar()


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per post: event counts by kind become its metrics.

    The counts are aggregated before the shuffle, so a post that holds a large
    share of all events costs no more than any other.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    n_docs = row_count(table(spark, sf_dir, "documents"))
    n_events = row_count(table(spark, sf_dir, "events"))
    post_id = F.floor(F.col("event_id").cast("double") * n_docs / n_events)
    counts = [F.count(F.when(F.col("event_type") == kind, 1)).alias(m) for m, kind in METRIC_OF_EVENT.items()]
    slashes = F.when(F.col("post_id") % 3 == 0, "//").when(F.col("post_id") % 3 == 1, "/").otherwise("")
    post_date = F.col("post_date")
    return (
        events.groupBy(post_id.cast("bigint").alias("post_id"))
        .agg(F.min("ts").alias("post_date"), *counts)
        .withColumns(
            {
                "post_url": F.concat(F.lit(f" https://{HOST}/posts/"), F.col("post_id").cast("string"), slashes),
                "engagement_rate": S.engagement_rate(
                    F.col("impressions"), F.col("reactions"), F.col("comments"), F.col("reposts")
                ),
                **S.date_parts(post_date),
                "hour": F.hour(post_date),
            }
        )
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected texts: the documents that carry a label."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labelled, "doc_id", "left_semi").select(
        F.concat(F.lit(f"https://{HOST}/posts/"), F.col("doc_id").cast("string")).alias("post_url"),
        F.col("text").alias("post_text"),
    )


def post_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``post_id, post_type``: the source number of a document picks its type.

    Two of nine sources give an unknown type and no type at all.
    """
    kinds = F.array(*[F.lit(k) for k in (*S.POST_TYPES, "Reel")])
    number = F.substring("source", 4, 10).cast("int") % 9
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"), F.get(kinds, number).alias("post_type")
    )


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post as one small sheet of labels and values, across or down."""
    p = posts(spark, sf_dir)
    values = [
        F.col("post_url"),
        F.date_format("post_date", "yyyy-MM-dd"),
        F.concat(F.hour("post_date").cast("string"), F.lit(":00")),
        *[F.col(m).cast("string") for m in METRICS],
    ]
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(part).alias("part"), v.alias("v"))
            for k, (label, value) in enumerate(zip(SHEET_LABELS, values))
            for part, v in ((0, F.lit(label)), (1, value))
        ]
    )
    across = F.col("post_id") % 3 == 1
    return (
        p.select("post_id", F.explode(entries).alias("e"))
        .select(
            F.col("post_id").cast("string").alias("file"),
            F.when(across, F.col("e.part")).otherwise(F.col("e.k")).alias("row"),
            F.when(across, F.col("e.k")).otherwise(F.col("e.part")).alias("col"),
            F.col("e.v").alias("value"),
            F.lit("string").alias("ctype"),
        )
    )
