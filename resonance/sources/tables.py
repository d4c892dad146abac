"""Typed table sources and sinks, and guards on their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST_SCHEMA = T.StructType(
    [
        T.StructField("post_url", T.StringType()),
        T.StructField("post_date", T.TimestampType()),
        T.StructField("weekday", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("impressions", T.LongType()),
        T.StructField("reactions", T.LongType()),
        T.StructField("comments", T.LongType()),
        T.StructField("reposts", T.LongType()),
        T.StructField("saves", T.LongType()),
        T.StructField("engagement_rate", T.DoubleType()),
    ]
)
TEXT_SCHEMA = T.StructType(
    [T.StructField("post_url", T.StringType()), T.StructField("post_text", T.StringType())]
)
POST_WITH_TEXT_SCHEMA = T.StructType([*POST_SCHEMA, TEXT_SCHEMA["post_text"]])
KEYWORD_SCHEMA = T.StructType(
    [T.StructField("keyword", T.StringType()), T.StructField("influence", T.DoubleType())]
)

# Texts hold line ends and quotes, so both directions quote, double the quote
# character and keep blanks.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "lineSep": "\n",
}


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read a table with a declared schema; no inference pass.

    A CSV with a text column is read record by record (``multiLine``), as texts hold
    line ends; such files cannot be split, so large tables belong in Parquet.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        multi_line = "post_text" in schema.fieldNames()
        reader = reader.options(**CSV_OPTIONS).option("multiLine", multi_line)
    return reader.format(fmt).load(path)


def read_posts(spark: SparkSession, path: str, fmt: str = "csv", with_text: bool = False) -> DataFrame:
    return read_table(spark, path, POST_WITH_TEXT_SCHEMA if with_text else POST_SCHEMA, fmt)


def read_texts(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, TEXT_SCHEMA, fmt)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a table, replacing an earlier one; one file per task."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(**CSV_WRITE_OPTIONS)
    writer.format(fmt).save(path)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise before any job runs if a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")
    return df


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    """Add ``name`` with a constant where the table lacks it."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def text_column(df: DataFrame, choices: tuple[str, ...] = ("post_text", "text")) -> str:
    """The first text column the table has."""
    for name in choices:
        if name in df.columns:
            return name
    raise ValueError(f"no text column among {choices}; the table has {df.columns}")


def existing(df: DataFrame, names) -> list[str]:
    """Those of ``names`` the table has, in the order given."""
    return [n for n in names if n in df.columns]
