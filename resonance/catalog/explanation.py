"""Attributions, keywords and words over whole tables and whole texts."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from resonance.catalog.common import JOINED, POSTS, r, register, rounded
from resonance.catalog.learning import scoring_bundle
from resonance.catalog.texts import VOCAB
from resonance.explain import trees, words
from resonance.learning import models
from resonance.operators import features, relational
from resonance.plans import flows, standins
from resonance.sources import scratch

TABULAR = 5 + 7


def _attributed(spark, sf_dir, first):
    table, fitted, _ = scoring_bundle(spark, sf_dir)
    scored = fitted.transform(table)
    names = models.scoring_feature_names(["impressions", "reactions", "comments", "reposts", "saves"])
    return scored, trees.tree_shap(scored, fitted.stages[-1], ["post_id"], names, first)


@register("m14_feature_attributions")
def m14_feature_attributions(spark, sf_dir):
    """Contribution of each number and category to each post's prediction."""
    _, shap = _attributed(spark, sf_dir, TABULAR)
    return shap


@register("m14_attributions_add_up", f"WITH {JOINED} SELECT post_id, true AS adds_up FROM joined")
def m14_attributions_add_up(spark, sf_dir):
    """Base value and all contributions together give the prediction."""
    table, fitted, _ = scoring_bundle(spark, sf_dir)
    scored = fitted.transform(table)
    wide = trees.tree_shap_wide(scored, fitted.stages[-1], ["post_id", "prediction"])
    total = F.aggregate("shap", F.col("base"), lambda a, x: a + x)
    return wide.select("post_id", (F.abs(total - F.col("prediction")) < 1e-6).alias("adds_up"))


@register("m15_model_importance")
def m15_model_importance(spark, sf_dir):
    """The twenty features with the largest mean contribution."""
    _, shap = _attributed(spark, sf_dir, None)
    return trees.global_importance(shap)


@register(
    "m15_mean_absolute_influence",
    f"""WITH e AS (SELECT role AS feature, CAST(length(text) AS DOUBLE)
        - avg(CAST(length(text) AS DOUBLE)) OVER (PARTITION BY conv_id) AS shap FROM conversations)
    SELECT feature, {r('avg(abs(shap))')} AS importance FROM e GROUP BY feature
    ORDER BY avg(abs(shap)) DESC, feature LIMIT 20""",
)
def m15_mean_absolute_influence(spark, sf_dir):
    """The same ranking on a table SQL can follow: turns of conversations by role."""
    turns = standins.table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("role").alias("feature"), F.length("text").cast("double").alias("score")
    )
    shaded = relational.influence_shades(turns, "conv_id", "score")
    ranked = trees.global_importance(shaded, value="contribution")
    return ranked.select("feature", rounded("importance").alias("importance"))


@register("m16_keyword_influence")
def m16_keyword_influence(spark, sf_dir):
    """Ridge weight of every keyword of the posts with engagement."""
    rows = scratch.written(flows.posts_with_text(spark, sf_dir).select("post_text", models.LABEL), "keyword-posts")
    return words.keyword_influence(rows)


@register("m17_text_model_keywords")
def m17_text_model_keywords(spark, sf_dir):
    """The twenty keywords that count most in the model of text and numbers."""
    posts = flows.posts_with_text(spark, sf_dir).select("post_text", *features.TEXT, models.LABEL)
    rows = scratch.written(posts, "keyword-posts")
    return words.text_model_keywords(words.fit_text_model(rows), spark)


@register("m18_word_influence")
def m18_word_influence(spark, sf_dir):
    """Contribution of every word of every post text to its predicted engagement."""
    table, fitted, _ = scoring_bundle(spark, sf_dir)
    return words.word_influence(table.where(F.col("post_text").isNotNull()), fitted)


@register(
    "m14_attributions_of_a_stump",
    f"""WITH {POSTS}, cuts AS (SELECT DISTINCT weekday AS t FROM posts),
    s AS (SELECT t, sum(CASE WHEN weekday <= t THEN engagement_rate END) AS sl, count(CASE WHEN weekday <= t THEN 1 END) AS nl,
            sum(CASE WHEN weekday > t THEN engagement_rate END) AS sr, count(CASE WHEN weekday > t THEN 1 END) AS nr
          FROM posts CROSS JOIN cuts GROUP BY t),
    best AS (SELECT t, sl / nl AS l, sr / nr AS r, (sl + sr) / (nl + nr) AS b FROM s WHERE nl > 0 AND nr > 0
             ORDER BY sl * sl / nl + sr * sr / nr DESC, t LIMIT 1)
    SELECT post_id, f.feature, {r('best.b')} AS base,
      CASE WHEN f.feature = 'weekday' THEN {r('CASE WHEN weekday <= t THEN best.l ELSE best.r END - best.b')} ELSE 0.0 END AS shap
    FROM posts, best, (VALUES ('weekday'), ('impressions_of_none')) AS f(feature)""",
)
def m14_attributions_of_a_stump(spark, sf_dir):
    """A tree of one split pays its weekday all that sets a prediction apart from the mean; a constant gets nothing."""
    names = ["weekday", "impressions_of_none"]
    posts = standins.posts(spark, sf_dir).withColumn("impressions_of_none", F.lit(0))
    table = models.assembler(names).transform(scratch.written(posts.select("post_id", *names, models.LABEL), "posts"))
    fitted = models.tree(maxDepth=1).fit(table)
    shap = trees.tree_shap(table, fitted, ["post_id"], names)
    return shap.select("post_id", "feature", rounded("base").alias("base"), rounded("shap").alias("shap"))


@register(
    "m16_influence_of_one_keyword",
    f"""WITH {VOCAB}, top AS (SELECT term FROM vocab ORDER BY tf DESC, term LIMIT 1),
    x AS (SELECT n_chars AS y, CASE WHEN doc_id IN (SELECT doc_id FROM tf WHERE term IN (SELECT term FROM top)) THEN 1.0 ELSE 0.0 END AS x
      FROM documents WHERE text IS NOT NULL AND n_chars > 0)
    SELECT term AS keyword, {r('(SELECT covar_pop(x, y) / (var_pop(x) + 2.5 / count(*)) FROM x)', 4)} AS influence FROM top""",
)
def m16_influence_of_one_keyword(spark, sf_dir):
    """A vocabulary of one keyword: its weight in a ridge model of the length of all documents, in closed form."""
    docs = standins.documents(spark, sf_dir).select("text", F.col("n_chars").cast("double").alias("n_chars"))
    table = words.keyword_influence(scratch.written(docs, "documents"), "text", "n_chars", alpha=2.5, size=1)
    return table.select("keyword", rounded("influence", 4).alias("influence"))


@register(
    "m18_word_influence_of_a_line",
    rf"""WITH {JOINED}, m AS (SELECT regr_slope(engagement_rate, length(post_text)) AS a FROM joined WHERE post_text IS NOT NULL),
    w AS (SELECT post_id, regexp_extract_all(post_text, '[^\s\x0b\x85\p{{Z}}]+') AS ws FROM joined WHERE post_text IS NOT NULL),
    e AS (SELECT post_id, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS word FROM w WHERE len(ws) >= 3),
    c AS (SELECT e.*, a * (length(word) - avg(length(word)) OVER (PARTITION BY post_id)) AS c FROM e, m)
    SELECT post_id, pos, word, round(c * 1e6, 3) + 0.0 AS contribution_1e6 FROM c""",
)
def m18_word_influence_of_a_line(spark, sf_dir):
    """A saved line on the length of a text: each word contributes by its length, less the mean of its post."""
    table = scratch.written(flows.posts_with_text(spark, sf_dir).select("post_id", "post_text", models.LABEL), "posts-with-text")
    length = SQLTransformer(statement="SELECT *, double(length(post_text)) AS letters FROM __THIS__")
    fitted = models.pipeline(length, models.assembler(["letters"]), models.linear()).fit(table.where("post_text IS NOT NULL"))
    found = words.word_influence(table.where("post_text IS NOT NULL"), fitted)
    scaled = F.round(F.col("contribution") * 1e6, 3) + F.lit(0.0)
    return found.select("post_id", "pos", "word", scaled.alias("contribution_1e6"))
