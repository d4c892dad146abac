"""The estimators compared, with their settings, and feature assembly."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)

from resonance.functions import scalars as S
from resonance.learning.encoder import TextEncoder
from resonance.learning.stages import (
    CategoryFlags,
    PopulationScaler,
    TfidfVectorizer,
    embedding_stages,
)
from resonance.operators import features

SEED = 42
DEEPEST = 30  # Spark's limit; stands for "no limit"
LABEL = "engagement_rate"


def assembler(blocks: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=blocks, outputCol=out, handleInvalid="error")


def size_guard(vector: str, size: int) -> VectorSizeHint:
    """Fail on a vector of another width than the model was built for."""
    return VectorSizeHint(inputCol=vector, size=size, handleInvalid="error")


def baseline_features(names=features.BASELINE) -> list:
    """Plain numeric columns as the feature vector."""
    return [assembler(list(names))]


def text_features(names=features.TEXT, text: str = "post_text", size: int = features.VOCABULARY_SIZE) -> list:
    """TF-IDF of the text followed by scaled numbers."""
    return [
        TfidfVectorizer(inputCol=text, outputCol="tfidf", size=size),
        PopulationScaler(inputCols=list(names), outputCol="numbers"),
        size_guard("numbers", len(names)),
        assembler(["tfidf", "numbers"]),
    ]


def scoring_features(names, category: str = "post_type", text: str = "post_text",
                     dim: int = features.EMBEDDING_SIZE, encoder: TextEncoder | None = None) -> list:
    """Scaled numbers, category flags and text embedding (that of ``encoder``, if given), in this order.

    Each block states its width: a vector of another width is an error, and the
    assembler need not run a job to find the widths (so it works on streams).
    """
    if encoder is None:
        embedding = embedding_stages(text, "embedding", dim)
    else:
        embedding, dim = [encoder.copy({encoder.inputCol: text, encoder.outputCol: "embedding"})], encoder.getSize()
    return [
        PopulationScaler(inputCols=list(names), outputCol="numbers"),
        size_guard("numbers", len(names)),
        CategoryFlags(inputCol=category, outputCol="flags"),
        size_guard("flags", len(S.POST_TYPES)),
        *embedding,
        size_guard("embedding", dim),
        assembler(["numbers", "flags", "embedding"]),
    ]


def scoring_feature_names(names, dim: int = features.EMBEDDING_SIZE) -> list[str]:
    flags = [f"post_type_{k}" for k in sorted(S.POST_TYPES)]
    return [*names, *flags, *[f"embedding_{i}" for i in range(dim)]]


def linear(label: str = LABEL, **kw) -> Estimator:
    return LinearRegression(labelCol=label, regParam=0.0, solver="normal", **kw)


def tree(label: str = LABEL, **kw) -> Estimator:
    settings = {"maxDepth": 5, "maxBins": 128, "seed": SEED, **kw}
    return DecisionTreeRegressor(labelCol=label, **settings)


def forest(label: str = LABEL, **kw) -> Estimator:
    """Every tree sees every feature; ``maxDepth`` 30 stands for unlimited."""
    settings = {"numTrees": 100, "maxDepth": DEEPEST, "featureSubsetStrategy": "all", "seed": SEED, **kw}
    return RandomForestRegressor(labelCol=label, **settings)


def boosted(label: str = LABEL, **kw) -> Estimator:
    settings = {
        "maxIter": 200,
        "maxDepth": 6,
        "stepSize": 0.05,
        "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8",
        "seed": SEED,
        **kw,
    }
    return GBTRegressor(labelCol=label, **settings)


def pipeline(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))
