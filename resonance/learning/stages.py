"""Spark ML stages the models need beyond the built-in ones."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    Normalizer,
    SQLTransformer,
    StandardScalerModel,
    VectorSlicer,
)
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasInputCol,
    HasInputCols,
    HasLabelCol,
    HasOutputCol,
    HasPredictionCol,
)
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, Identifiable
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from resonance.functions import scalars as S
from resonance.functions.text import ENGLISH_STOP_WORDS, terms_sql, tokens_sql
from resonance.learning import gram
from resonance.operators import features


class PopulationScaler(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Standard scores over the population deviation, as one vector; nulls count as 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        cols = self.getInputCols()
        numbers = dataset.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
        stats = numbers.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
        ).first()
        model = PopulationScalerModel(
            means=[float(stats[f"m{i}"] or 0.0) for i in range(len(cols))],
            deviations=[float(stats[f"s{i}"] or 1.0) for i in range(len(cols))],
        )
        return self._copyValues(model)


class PopulationScalerModel(Model, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean of each column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "deviation of each column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, means=None, deviations=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        scores = [
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / d
            for c, m, d in zip(self.getInputCols(), self.getOrDefault("means"), self.getOrDefault("deviations"))
        ]
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*scores)))


class VectorStandardizer(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Standard scores of a whole vector over the population deviation, by Spark's own scaler model; one pass."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        summary = Summarizer.metrics("mean", "variance", "count").summary(F.col(self.getInputCol()))
        about = dataset.select(summary.alias("s")).first()["s"]
        # Spark's variance is the sample's.
        n, context = about["count"], dataset.sparkSession.sparkContext
        deviations = (about["variance"].toArray() * ((n - 1) / n if n else 0.0)) ** 0.5
        java = context._jvm.org.apache.spark.ml.feature.StandardScalerModel(
            Identifiable().uid, *[_py2java(context, Vectors.dense(v)) for v in (deviations, about["mean"])])
        model = StandardScalerModel(java)
        model._resetUid(java.uid())
        return model._set(withMean=True, withStd=True, inputCol=self.getInputCol(), outputCol=self.getOutputCol())


class CategoryFlags(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot vector over fixed categories in alphabetical order; a value not listed reads as ``fallback``."""

    categories = Param(Params._dummy(), "categories", "known values", TypeConverters.toListString)
    fallback = Param(Params._dummy(), "fallback", "value of unknown ones", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, categories=None, fallback="Text"):
        super().__init__()
        self._setDefault(categories=list(S.POST_TYPES), fallback="Text")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset):
        known = self.getOrDefault("categories")
        value = S.known_or(F.col(self.getInputCol()), known, self.getOrDefault("fallback"))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(features.one_hot(value, known)))


def term_stage(text: str, out: str = "terms", ngrams: int = 2, stop_words=ENGLISH_STOP_WORDS) -> SQLTransformer:
    """Native stage that adds the terms of a text column (null reads as empty)."""
    tokens = tokens_sql(f"coalesce({text}, '')", stop_words)
    return SQLTransformer(
        statement=f"SELECT *, {terms_sql('_tokens', ngrams)} AS {out} "
        f"FROM (SELECT *, {tokens} AS _tokens FROM __THIS__)"
    )


def drop_stage(*names: str) -> SQLTransformer:
    """Native stage that removes helper columns."""
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(names)}) FROM __THIS__")


def embedding_stages(text: str, out: str = "embedding", dim: int = features.EMBEDDING_SIZE) -> list:
    """Native stages giving the hashed-term unit vector of a text column."""
    return [
        term_stage(text, "_terms"),
        HashingTF(numFeatures=dim, inputCol="_terms", outputCol="_counts"),
        Normalizer(p=2.0, inputCol="_counts", outputCol=out),
        drop_stage("_terms", "_counts", "_tokens"),
    ]


class TfidfVectorizer(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """TF-IDF vectors of words and word pairs; fitting gives a native ``PipelineModel``.

    Vocabulary and document counts come from one distributed aggregation; applying
    the model is row by row in the JVM, without a shuffle.
    """

    size = Param(Params._dummy(), "size", "largest vocabulary", TypeConverters.toInt)
    ngrams = Param(Params._dummy(), "ngrams", "1 for words, 2 for words and pairs", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=features.VOCABULARY_SIZE, ngrams=2):
        super().__init__()
        self._setDefault(size=features.VOCABULARY_SIZE, ngrams=2)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset):
        text, out = self.getInputCol(), self.getOutputCol()
        ngrams = self.getOrDefault("ngrams")
        vocab = features.vocabulary(dataset, text, self.getOrDefault("size"), ngrams=ngrams)
        n_docs = dataset.select(F.count(text).alias("n")).scalar()
        # At most ``size`` rows: the model itself, in alphabetical order of terms.
        rows = vocab.withColumn("_n", n_docs).select(
            "term", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf")
        ).collect()
        if not rows:
            raise ValueError("no text holds any term")
        rows.sort(key=lambda row: row["term"])
        return PipelineModel(
            [
                term_stage(text, "_terms", ngrams),
                CountVectorizerModel.from_vocabulary([row["term"] for row in rows], "_terms", "_counts"),
                ElementwiseProduct(
                    scalingVec=Vectors.dense([row["idf"] for row in rows]), inputCol="_counts", outputCol="_weights"
                ),
                Normalizer(p=2.0, inputCol="_weights", outputCol=out),
                drop_stage("_terms", "_counts", "_weights", "_tokens"),
            ]
        )


def tfidf_terms(model: PipelineModel) -> list[str]:
    """Vocabulary of a fitted :class:`TfidfVectorizer`, by vector position."""
    return next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary


class RidgeRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable,
                      DefaultParamsWritable):
    """Least squares with penalty ``alpha * |w|^2`` on the sum of squares; free intercept.

    Spark scales its penalty by the label's deviation and the row count, both of
    the training rows, so its parameter is set at fitting time. ``solver`` is
    ``normal`` (Spark's one pass and solve on the driver: for a few hundred features),
    ``gram`` (two passes, see :mod:`gram`: for a few thousand, sparse ones too) or
    ``l-bfgs`` (many light passes, for more).
    """

    alpha = Param(Params._dummy(), "alpha", "penalty on the squared weights", TypeConverters.toFloat)
    solver = Param(Params._dummy(), "solver", "normal, gram or l-bfgs", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", alpha=1.0,
                 solver="normal"):
        super().__init__()
        self._setDefault(alpha=1.0, solver="normal")
        self._set(**self._input_kwargs)

    def getAlpha(self) -> float:
        return self.getOrDefault("alpha")

    def _fit(self, dataset):
        label, vector = self.getLabelCol(), self.getFeaturesCol()
        if self.getOrDefault("solver") == "gram":
            (whole,) = gram.moments(dataset, vector, label).values()
            line = gram.ridge(whole, [self.getAlpha()])
            return linear_model(dataset.sparkSession, line.weights[:, 0], line.offsets[0], vector, self.getPredictionCol())
        stats = dataset.select(
            F.count(label).alias("n"),
            F.stddev_pop(label).alias("population"),
            F.stddev_samp(label).alias("sample"),
            Summarizer.variance(F.col(vector)).alias("variance"),
        ).first()
        # A constant feature has weight 0; left in, it makes the equations singular.
        varying = [i for i, v in enumerate(stats["variance"]) if v > 0]
        constant = len(varying) < len(stats["variance"])
        solver = self.getOrDefault("solver")
        deviation = (stats["population"] if solver == "normal" else stats["sample"]) or 0.0
        inner = LinearRegression(
            featuresCol="_varying" if constant else vector,
            labelCol=label,
            predictionCol=self.getPredictionCol(),
            regParam=self.getAlpha() * deviation / stats["n"],
            elasticNetParam=0.0,
            standardization=False,
            solver=solver,
            maxIter=300,
            tol=1e-10,
        )
        if not constant:
            return inner.fit(dataset)
        slicer = VectorSlicer(inputCol=vector, outputCol="_varying", indices=varying)
        return PipelineModel([slicer, inner.fit(slicer.transform(dataset)), drop_stage("_varying")])


def linear_model(spark: SparkSession, weights, offset: float, features: str, prediction: str) -> LinearRegressionModel:
    """Spark's own linear model with given weights: it predicts in the JVM and is saved like any other."""
    context = spark.sparkContext
    java = context._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
        Identifiable().uid, _py2java(context, Vectors.dense(weights)), float(offset))
    model = LinearRegressionModel(java)
    model._resetUid(java.uid())
    return model.setFeaturesCol(features).setPredictionCol(prediction)


def ridge_weights(model, size: int) -> list[float]:
    """Weight of each of the ``size`` features of a fitted :class:`RidgeRegression`."""
    if not isinstance(model, PipelineModel):
        return list(model.coefficients.toArray())
    slicer, inner = model.stages[0], model.stages[1]
    weights = [0.0] * size
    for i, w in zip(slicer.getIndices(), inner.coefficients.toArray()):
        weights[i] = float(w)
    return weights
