"""Which keywords go with engagement, and what each word of a post contributes."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.explain.leafsets import LeafSets, joint_score, scores_of_kinds, with_masks
from resonance.functions import scalars as S
from resonance.learning.models import LABEL, text_features
from resonance.learning.stages import RidgeRegression, TfidfVectorizer, ridge_weights, tfidf_terms
from resonance.operators import features, relational
from resonance.sources import tables
from resonance.sources.scratch import shuffles_dropped, written
from resonance.sources.tables import KEYWORD_SCHEMA

FEWEST_WORDS = 3
#: Bytes of the masks of kinds of words that are broadcast.
KIND_BYTES = 32 << 20
#: Words whose scores are worked out in one query, and such queries at most.
AT_ONCE, ROUNDS = 50_000_000, 8
TREE_MODELS = (DecisionTreeRegressionModel, RandomForestRegressionModel, GBTRegressionModel)


def _weight_table(spark, terms: list[str], weights: list[float]) -> DataFrame:
    """One row per vocabulary term; as small as the vocabulary."""
    return spark.createDataFrame(list(zip(terms, map(float, weights))), KEYWORD_SCHEMA)


def keyword_influence(df: DataFrame, text: str = "post_text", label: str = LABEL, alpha: float = 1.0,
                      size: int = features.VOCABULARY_SIZE) -> DataFrame:
    """Ridge weight of every keyword, from all posts with text and engagement."""
    rows = relational.engaged(df, text, label).select(text, label)
    vectorizer = TfidfVectorizer(inputCol=text, outputCol="tfidf", size=size).fit(rows)
    terms = tfidf_terms(vectorizer)
    model = RidgeRegression(featuresCol="tfidf", labelCol=label, alpha=alpha, solver="gram").fit(vectorizer.transform(rows))
    return _weight_table(df.sparkSession, terms, ridge_weights(model, len(terms)))


def fit_text_model(df: DataFrame, text: str = "post_text", label: str = LABEL, alpha: float = 1.0,
                   size: int = features.VOCABULARY_SIZE) -> PipelineModel:
    """TF-IDF and scaled numbers into a ridge model, on posts with a text."""
    rows = relational.drop_missing(df, text, label)
    stages = [*text_features(text=text, size=size), RidgeRegression(labelCol=label, alpha=alpha, solver="gram")]
    return Pipeline(stages=stages).fit(rows)


def text_model_keywords(model: PipelineModel, spark, k: int = 20) -> DataFrame:
    """The ``k`` keywords with the largest weights in a text model; its number weights are left out."""
    terms = tfidf_terms(model.stages[0])
    width = len(terms) + len(features.TEXT)
    weights = ridge_weights(model.stages[-1], width)[: len(terms)]
    return _weight_table(spark, terms, weights).orderBy(F.col("influence").desc(), "keyword").limit(k)


def word_scores(df: DataFrame, bundle: PipelineModel, key: str = "post_id", text: str = "post_text") -> DataFrame:
    """``key, pos, word, score``: score of each word standing alone for its post's text, all other columns unchanged."""
    words = S.words(F.col(text))
    long_enough = df.where(S.not_blank(F.col(text)) & (F.size(words) >= FEWEST_WORDS))
    where = _text_columns(bundle)
    if where is not None and isinstance(bundle.stages[-1], TREE_MODELS):
        return _scores_by_leaf_sets(long_enough, bundle, key, text, where)
    each = features.exploded(long_enough, ["*"], words, "word", "pos").withColumn(text, F.col("word"))
    return bundle.transform(each).select(key, "pos", "word", F.col("prediction").alias("score"))


def _text_columns(bundle: PipelineModel) -> tuple[int, range] | None:
    """Where the text vector, the last block of the assembled features, lies; none if the bundle does not say."""
    blocks = [s for s in bundle.stages if isinstance(s, VectorAssembler)]
    sizes = {s.getInputCol(): s.getSize() for s in bundle.stages if isinstance(s, VectorSizeHint)}
    if not blocks or not set(blocks[-1].getInputCols()) <= set(sizes):
        return None
    widths = [sizes[c] for c in blocks[-1].getInputCols()]
    return sum(widths[:-1]), range(sum(widths[:-1]), sum(widths))


def _scores_by_leaf_sets(posts: DataFrame, bundle: PipelineModel, key: str, text: str, where: tuple[int, range]) -> DataFrame:
    """Word scores of a tree model. Posts and distinct words each get their masks; only their pairs meet.

    A word is embedded once, wherever it stands. Words that rule out the same leaves are one kind. Where there are few
    kinds, their masks are broadcast and a post is scored as one row, once for each kind in it; otherwise a pair of post
    and mask is. Posts of one key are taken to be one post.
    """
    tabular, text_part = where
    before, model, spark = PipelineModel(bundle.stages[:-1]), bundle.stages[-1], posts.sparkSession
    leaves = LeafSets(spark, model)
    sets = spark.sparkContext.broadcast(leaves)  # the model
    ready = tables.ensure_column(posts, "post_type", "Text")
    occurrences = written(features.exploded(posts, [key], S.words(F.col(text)), "word", "pos").select(key, "pos", "word"), "words")

    # The stages read all their columns; those of a word's post do not matter here.
    others = {f.name: F.lit(None).cast(f.dataType) for f in ready.schema if f.name != text}
    distinct = occurrences.select("word").distinct().withColumns({**others, text: F.col("word")})
    masks = written(with_masks(before.transform(distinct), ["word"], sets, text_part, named=True), "word-masks")
    kinds = masks.where("mask is not null").groupBy("a", "b").agg(F.min("mask").alias("word_mask"))
    blank = before.transform(ready.withColumn(text, F.lit("")))
    post_masks = written(with_masks(blank, [key], sets, range(tabular)).dropDuplicates([key]), "post-masks")

    few = KIND_BYTES // leaves.full.nbytes
    found = kinds.limit(few + 1).collect()
    if len(found) <= few:
        table = np.frombuffer(b"".join(r["word_mask"] for r in found), np.uint64).reshape(len(found), -1)
        numbers = spark.createDataFrame([(r["a"], r["b"], i) for i, r in enumerate(found)], "a long, b long, kind int")
        kind_of = masks.join(F.broadcast(numbers), ["a", "b"]).select("word", "kind")
        scores = scores_of_kinds(sets, spark.sparkContext.broadcast(table), "mask", "kinds")
        rounds = max(1, min(ROUNDS, -(-occurrences.count() // AT_ONCE)))
        parts = []
        for now in range(rounds):
            # All words of a post move to its task: on disk lie those of a round only.
            mine, its_masks = (d.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == now) for d in (occurrences, post_masks))
            lists = mine.join(kind_of, "word").groupBy(key).agg(F.collect_list(F.struct("pos", "word", "kind")).alias("all"))
            of_post = lists.join(its_masks, key).withColumn("kinds", F.col("all.kind"))
            each = of_post.select(key, "all", scores.alias("scores")).select(key, F.explode(F.arrays_zip("all", "scores")).alias("e"))
            part = each.select(key, "e.all.pos", "e.all.word", F.col("e.scores").alias("score"))
            parts.append(written(part, "word-scores-part") if rounds > 1 else part)
        return reduce(DataFrame.unionByName, parts)
    same = F.struct("a", "b").alias("same")
    named = occurrences.join(masks.select("word", same), "word")
    pairs = named.select(key, "same").distinct().join(post_masks, key).join(kinds.select(same, "word_mask"), "same")
    scored = written(pairs.select(key, "same", joint_score(sets).alias("score")), "pair-scores")
    return named.join(scored, [key, "same"]).select(key, "pos", "word", "score")


def word_influence(df: DataFrame, bundle: PipelineModel, key: str = "post_id", text: str = "post_text") -> DataFrame:
    """``key, pos, word, contribution, opacity, colour`` for every word of every post.

    Scores are written once to shared storage: they are read twice, for the mean
    of each post and for its words.
    """
    with shuffles_dropped(df.sparkSession):
        scores = written(word_scores(df, bundle, key, text), "word-scores")
    shaded = relational.influence_shades(scores, key, "score")
    return shaded.select(key, "pos", "word", "contribution", "opacity", "colour")
