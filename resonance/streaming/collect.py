"""Incremental collection of post texts from a stream of arriving files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from resonance.operators.relational import new_texts
from resonance.sources.tables import TEXT_SCHEMA


def collected(spark: SparkSession, store: str) -> DataFrame:
    """The texts collected so far, with the run and batch that brought them."""
    schema = T.StructType([*TEXT_SCHEMA, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).option("basePath", store).parquet(store)


def collect_texts(incoming: DataFrame, store: str, checkpoint: str, normalize: bool = False) -> StreamingQuery:
    """Append the new texts of a stream to ``store``; runs until the input at hand is used up.

    Each micro-batch is an anti join against all that is stored but for its own
    folder, which it replaces, so a batch replayed after a failure adds nothing
    twice. The folder is named by the run (the id kept in the checkpoint) and the
    batch, so other sources and checkpoints add to the same store. No state is
    kept between batches.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_id(spark, checkpoint)
        done = _stored_elsewhere(spark, store, run, batch_id)
        fresh = new_texts(batch, done, normalize=normalize)
        fresh.select("post_url", "post_text").write.mode("overwrite").parquet(f"{store}/run={run}/batch={batch_id}")

    return (
        incoming.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the query that a checkpoint belongs to; the same after a restart."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def _stored_elsewhere(spark: SparkSession, store: str, run: str, batch_id: int) -> DataFrame:
    """Texts of all batches of all runs but this one."""
    try:
        every = collected(spark, store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TEXT_SCHEMA)
    own = (F.col("run") == run) & (F.col("batch") == batch_id)
    return every.where(~own).drop("run", "batch")
