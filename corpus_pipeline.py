"""A pipeline over documents: each stage is an operator of resonance.llm whose decisions take effect.

Documents whose language cannot be told go, then lines that many sites repeat, then all but one of each group of
near copies; personal data is masked, and what is left is packed into sequences for training.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonance.llm import catalog, jaccard, language, lines, packing, pii
from resonance.llm.support import row_columns
from resonance.sources.scratch import drop, scratch_path, temporary

#: A language surer than this is a decision; less is a rejection, as is a text without letters.
LEAST_SURE = 0.5


def with_text(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of documents with another text, and its length."""
    kinds = dict(docs.dtypes)
    return row_columns(docs, text=text, **({"n_chars": F.length(text).cast(kinds["n_chars"])} if "n_chars" in kinds else {}))


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure of. It learns from all rows with a text and a language."""
    found = language.identify(docs, language.train(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)).select(*row_columns(docs))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those of which nothing is left go."""
    cleaned = lines.remove_boilerplate(docs)
    left = cleaned.where((F.col("n_removed") == 0) | (F.trim("cleaned") != ""))
    return left.select(*with_text(docs, F.col("cleaned")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies. Rows of one id stay or go together."""
    groups = jaccard.similar_groups(docs, width=5, num=80, den=100)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"))
    return rows.join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti").select(*row_columns(docs))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind."""
    found = pii.find(docs, pii.train(docs))
    return found.select(*with_text(docs, F.coalesce("masked", F.col("row.text"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, catalog.tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", told_language),
    ("lines", without_boilerplate),
    ("near_copies", one_of_each_group),
    ("personal_data", masked),
    ("packing", packed),
]

#: No SQL: language, personal data and tokens are not SQL's. Tests compare it with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next.

    What a stage wrote for itself, and the table it read, are removed when its own table is written; the last one stays.
    An empty table goes through all stages.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
