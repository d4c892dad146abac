"""The scoring bundle: features and model in one saved pipeline, with its description."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonance.functions import scalars as S
from resonance.learning import models
from resonance.learning.encoder import TextEncoder
from resonance.operators import features
from resonance.sources import tables

ABOUT_SCHEMA = (
    "numeric_features array<string>, categorical_feature string, encoder_feature_names array<string>, "
    "allowed_post_types array<string>, embedding_dim int, expected_dim int"
)


def fit_preprocessor(df: DataFrame, text: str | None = None, category: str = "post_type",
                     dim: int = features.EMBEDDING_SIZE, encoder: TextEncoder | None = None) -> tuple[PipelineModel, DataFrame]:
    """Fit scaling and encoding on the whole table: ``(model, one-row description)``. ``encoder``: of the user's own."""
    dim = encoder.getSize() if encoder else dim
    text = text or tables.text_column(df)
    numeric = tables.existing(df, features.SCORING)
    ready = tables.ensure_column(df, category, "Text")
    model = models.pipeline(*models.scoring_features(numeric, category, text, dim, encoder)).fit(ready)
    flags = [f"{category}_{k}" for k in sorted(S.POST_TYPES)]
    about = [(numeric, category, flags, list(S.POST_TYPES), dim, len(numeric) + len(flags) + dim)]
    return model, df.sparkSession.createDataFrame(about, ABOUT_SCHEMA)


#: A table of more rows than this is dealt evenly before a model is fitted; rows of such a piece at most.
AS_IT_IS, PIECE = 16_384, 50_000


def dealt(rows: DataFrame) -> DataFrame:
    """A persisted table in even pieces, a multiple of the cores, if it is large; the caller unpersists what it gets.

    Pieces that joins leave are even in bytes: rows without a text may all lie in one, and every pass waits for it.
    """
    n = rows.count()
    if n <= AS_IT_IS:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    even = rows.repartition(cores * -(-n // (cores * PIECE))).persist()
    even.count()
    rows.unpersist()
    return even


def fit_bundle(preprocessor: PipelineModel, train: DataFrame, estimator=None) -> PipelineModel:
    """Preprocessor and a model fitted behind it as one pipeline."""
    featured = preprocessor.transform(tables.ensure_column(train, "post_type", "Text"))
    rows = featured.select("features", models.LABEL).persist()
    try:
        rows = dealt(rows)
        model = (estimator or models.boosted()).fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel([*preprocessor.stages, model])


def save_bundle(model: PipelineModel, path: str, about: DataFrame | None = None) -> None:
    model.write().overwrite().save(f"{path}/model")
    if about is not None:
        about.write.mode("overwrite").json(f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.schema(ABOUT_SCHEMA).json(f"{path}/about")


def score(df: DataFrame, bundle: PipelineModel, skip_blank: str | None = None) -> DataFrame:
    """Predict for every row of a batch or streaming table.

    ``skip_blank`` names a text column whose blank rows are left out. The result
    is the engagement ratio, as in the training data.
    """
    rows = df.where(S.not_blank(F.col(skip_blank))) if skip_blank else df
    return bundle.transform(tables.ensure_column(rows, "post_type", "Text"))
