"""Streaming collection and scoring over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from resonance.catalog.common import register
from resonance.catalog.learning import scoring_bundle
from resonance.learning import bundle as bundles
from resonance.plans import standins
from resonance.sources import scratch
from resonance.streaming.collect import collect_texts, collected
from resonance.streaming.keystore import KeyStore, collect_by_key
from resonance.streaming.scoring import score_stream


def _document_stream(spark, sf_dir):
    """Documents as a stream: one file, or a folder of part files. A stream takes a single file by a pattern only."""
    schema = standins.table(spark, sf_dir, "documents").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


@register(
    "s6_streaming_collection",
    f"""SELECT concat('https://www.example.com/posts/', CAST(doc_id AS VARCHAR)) AS post_url,
      trim(text, {_BLANKS}) AS post_text FROM documents WHERE trim(text, {_BLANKS}) <> ''""",
)
def s6_streaming_collection(spark, sf_dir):
    """All documents arrive as a stream; those with a text are stored."""
    incoming = _document_stream(spark, sf_dir).select(
        F.concat(F.lit(f"https://{standins.HOST}/posts/"), F.col("doc_id").cast("string")).alias("post_url"),
        F.col("text").alias("post_text"),
    )
    base = scratch.scratch_path(spark, "collect")
    collect_texts(incoming, f"{base}/store", f"{base}/first").awaitTermination()
    return collected(spark, f"{base}/store").drop("run", "batch")


@register(
    "s6_collection_of_two_runs",
    f"""SELECT concat('https://www.example.com/posts/', CAST(doc_id AS VARCHAR)) AS post_url,
      trim(text, {_BLANKS}) AS post_text FROM documents WHERE trim(text, {_BLANKS}) <> ''""",
)
def s6_collection_of_two_runs(spark, sf_dir):
    """Two streams with checkpoints of their own fill one store; texts both bring are stored once."""
    incoming = _document_stream(spark, sf_dir).select(
        F.concat(F.lit(f"https://{standins.HOST}/posts/"), F.col("doc_id").cast("string")).alias("post_url"),
        F.col("text").alias("post_text"), (F.col("doc_id") % 3).alias("part"),
    )
    base = scratch.scratch_path(spark, "collect")
    for run, part in (("first", F.col("part") < 2), ("second", F.col("part") > 0)):
        texts = incoming.where(part).drop("part")
        collect_texts(texts, f"{base}/store", f"{base}/{run}").awaitTermination()
    return collected(spark, f"{base}/store").drop("run", "batch")


@register(
    "s6_collection_by_key_index",
    f"""SELECT concat('https://www.example.com/posts/', CAST(doc_id AS VARCHAR)) AS post_url,
      trim(text, {_BLANKS}) AS post_text FROM documents WHERE trim(text, {_BLANKS}) <> ''""",
)
def s6_collection_by_key_index(spark, sf_dir):
    """The same two streams into a store with a key index and commits."""
    incoming = _document_stream(spark, sf_dir).select(
        F.concat(F.lit(f"https://{standins.HOST}/posts/"), F.col("doc_id").cast("string")).alias("post_url"),
        F.col("text").alias("post_text"), (F.col("doc_id") % 3).alias("part"),
    )
    base = scratch.scratch_path(spark, "collect")
    for run, part in (("first", F.col("part") < 2), ("second", F.col("part") > 0)):
        collect_by_key(incoming.where(part).drop("part"), f"{base}/store", f"{base}/{run}").awaitTermination()
    return KeyStore(spark, f"{base}/store").texts()


@register("m13_streaming_scores", "SELECT doc_id AS post_id, true AS same FROM documents")
def m13_streaming_scores(spark, sf_dir):
    """Drafts scored from a stream get the predictions of the batch scorer."""
    _, fitted, _ = scoring_bundle(spark, sf_dir)

    def drafts(docs):
        count = F.col("n_chars") % 7
        return docs.select(
            F.col("doc_id").alias("post_id"),
            F.col("text").alias("post_text"),
            F.lit("Image").alias("post_type"),
            *[(count + i).alias(m) for i, m in enumerate(standins.METRICS)],
        )

    base = scratch.scratch_path(spark, "scores")
    stream = drafts(_document_stream(spark, sf_dir))
    score_stream(stream, fitted, f"{base}/out", f"{base}/checkpoint", "post_id").awaitTermination()
    streamed = spark.read.parquet(f"{base}/out").withColumnRenamed("prediction", "p")
    batch = bundles.score(drafts(standins.table(spark, sf_dir, "documents")), fitted).select("post_id", "prediction")
    return streamed.join(batch, "post_id").select("post_id", (F.col("p") == F.col("prediction")).alias("same"))
