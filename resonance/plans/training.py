"""Training flows: from posts with text to evaluated, saved models."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.learning import bundle, metrics, models, splits, tuning
from resonance.learning.encoder import TextEncoder
from resonance.learning.stages import RidgeRegression
from resonance.operators import features, relational
from resonance.sources import tables
from resonance.sources.scratch import written

LABEL = models.LABEL


def evaluated(train: DataFrame, test: DataFrame, stages: list, name: str) -> DataFrame:
    """Fit on ``train``, one row of metrics on ``test``."""
    predicted = models.pipeline(*stages).fit(train).transform(test)
    scores = metrics.regression_metrics(predicted)
    return scores.select(F.lit(name).alias("model"), "n", "mae", "rmse", "r2")


def _train_test(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both parts of a table written once: fitting reads it several times."""
    return splits.split(written(df, "training-table"), key)


def baseline_models(posts: DataFrame, key: str = "post_id", names=features.BASELINE) -> DataFrame:
    """Least squares and a depth-5 tree on a few numbers."""
    clean = relational.fill_numeric(relational.drop_missing(posts, LABEL), names)
    train, test = _train_test(clean.select(key, *names, LABEL), key)
    line = evaluated(train, test, [*models.baseline_features(names), models.linear()], "LinearRegression")
    tree = evaluated(train, test, [*models.baseline_features(names), models.tree()], "DecisionTree")
    return line.unionByName(tree)


def text_model(posts: DataFrame, key: str = "post_id", text: str = "post_text", names=features.TEXT) -> DataFrame:
    """TF-IDF of the text and numbers into ridge."""
    rows = relational.drop_missing(tables.require_columns(posts, text), text, LABEL)
    train, test = _train_test(rows.select(key, text, *names, LABEL), key)
    stages = [*models.text_features(names, text), RidgeRegression(labelCol=LABEL, solver="gram")]
    return evaluated(train, test, stages, "TF-IDF + Ridge")


def embedding_model(posts: DataFrame, key: str = "post_id", text: str = "post_text",
                    embed=features.hashed_embedding) -> DataFrame:
    """Text vectors alone into ridge; ``embed(df, text, out)`` adds the vectors."""
    rows = relational.drop_missing(tables.require_columns(posts, text), text, LABEL).select(key, text, LABEL)
    train, test = _train_test(embed(rows, text, "features"), key)
    return evaluated(train, test, [RidgeRegression(labelCol=LABEL)], "Embedding + Ridge")


def tuning_table(posts: DataFrame, key: str = "post_id", text: str = "post_text",
                 embed=features.hashed_embedding, contiguous: bool = True) -> DataFrame:
    """Key, feature vector (text vector, then numbers), label and fold of each post with text."""
    rows = relational.drop_missing(tables.require_columns(posts, text), text)
    assign = splits.with_contiguous_fold if contiguous else splits.with_hash_fold
    folded = assign(relational.fill_numeric(rows, features.TUNING), key)
    vectors = embed(folded, text, "embedding")
    joined = models.assembler(["embedding", *features.TUNING]).transform(vectors)
    return written(joined.select(key, "features", LABEL, "fold"), "tuning-table")


def compare_models(table: DataFrame, grids: dict | None = None, parallelism: int = 2) -> DataFrame:
    """Grid search of each kind of model on one tuning table, best R2 first."""
    cached = table.persist()
    try:
        results = [
            tuning.grid_search(cached, name, grid, parallelism=parallelism, refit=False)
            for name, grid in (grids or tuning.GRIDS).items()
        ]
    finally:
        cached.unpersist()
    return metrics.leaderboard(table.sparkSession, results)


def train_scorer(posts: DataFrame, path: str | None = None, key: str = "post_id",
                 estimator: Estimator | None = None, encoder: TextEncoder | None = None) -> tuple[PipelineModel, DataFrame]:
    """Preprocessor on all posts, boosted trees on the training part: ``(bundle, test metrics)``.

    With ``path`` the bundle and its description are saved there. Texts get the vectors of ``encoder``, if given.
    """
    preprocessor, about = bundle.fit_preprocessor(posts, encoder=encoder)
    train, test = splits.split(posts, key)
    fitted = bundle.fit_bundle(preprocessor, train, estimator)
    if path:
        bundle.save_bundle(fitted, path, about)
    return fitted, metrics.regression_metrics(bundle.score(test, fitted))
