"""Regression metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _metric_columns(label: str, prediction: str) -> dict[str, Column]:
    """MAE, MSE and R2 of a group of rows in one pass.

    The spread of the labels is Spark's centred variance, which stays exact for
    labels far from zero. Without spread, R2 is 1 for a perfect fit, else 0.
    """
    error = F.col(label) - F.col(prediction)
    squared = F.sum(error * error)
    spread = F.var_pop(label) * F.count(label)
    return {
        "n": F.count(F.lit(1)),
        "mae": F.avg(F.abs(error)),
        "mse": F.avg(error * error),
        "r2": F.when(spread > 0, 1 - squared / spread).when(squared == 0, 1.0).otherwise(0.0),
    }


def regression_metrics(pred: DataFrame, label: str = "engagement_rate", prediction: str = "prediction",
                       by: Sequence[str] = ()) -> DataFrame:
    """``by, n, mae, rmse, r2`` of predictions."""
    columns = _metric_columns(label, prediction)
    out = pred.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()])
    return out.select(*by, "n", "mae", F.sqrt("mse").alias("rmse"), "r2")


def fold_metrics(pred: DataFrame, fold: str = "fold", label: str = "engagement_rate",
                 prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Cross-validated metrics: means over folds, RMSE as root of the mean MSE."""
    per_fold = pred.groupBy(*by, fold).agg(*[c.alias(n) for n, c in _metric_columns(label, prediction).items()])
    return per_fold.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("r2").alias("r2"),
        F.avg("mae").alias("mae"),
        F.sqrt(F.avg("mse")).alias("rmse"),
    )


LEADERBOARD_SCHEMA = "model string, best_params map<string,string>, r2 double, mae double, rmse double"


def leaderboard(spark: SparkSession, results: list[dict]) -> DataFrame:
    """One row per tuned model, best R2 first."""
    rows = [
        (r["model"], {k: str(v) for k, v in r["best_params"].items()}, float(r["r2"]), float(r["mae"]), float(r["rmse"]))
        for r in results
    ]
    return spark.createDataFrame(rows, LEADERBOARD_SCHEMA).orderBy(F.col("r2").desc(), "model")
