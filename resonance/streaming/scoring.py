"""Scoring of arriving drafts with a fitted bundle."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from resonance.learning.bundle import score


def score_stream(drafts: DataFrame, bundle: PipelineModel, out: str, checkpoint: str, *keep: str) -> StreamingQuery:
    """Append ``keep`` and the prediction of each arriving row to ``out``; the batch scorer, unchanged."""
    return (
        score(drafts, bundle)
        .select(*keep, "prediction")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
