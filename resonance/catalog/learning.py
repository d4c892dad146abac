"""Splits, metrics, models and tuning over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.catalog.common import JOINED, POSTS, r, register, rounded
from resonance.learning import bundle as bundles
from resonance.learning import metrics, models, splits, tuning
from resonance.learning.perceptron import PerceptronRegressor
from resonance.learning.stages import PopulationScaler, RidgeRegression
from resonance.operators import describe, features, relational
from resonance.plans import flows, standins, training
from resonance.sources import scratch

LABEL = models.LABEL


def _share(key: str) -> str:
    return f"CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


@register(
    "m1_train_test_split",
    f"""WITH {POSTS} SELECT post_id, CASE WHEN {_share('post_id')} < 0.2 THEN 'test' ELSE 'train' END AS part FROM posts""",
)
def m1_train_test_split(spark, sf_dir):
    train, test = splits.split(standins.posts(spark, sf_dir).select("post_id"), "post_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@register(
    "m9_hash_folds",
    f"WITH {POSTS} SELECT post_id, CAST(floor(({_share('post_id')}) * 5) AS INTEGER) AS fold FROM posts",
)
def m9_hash_folds(spark, sf_dir):
    return splits.with_hash_fold(standins.posts(spark, sf_dir).select("post_id"), "post_id")


@register(
    "m9_contiguous_folds",
    "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
)
def m9_contiguous_folds(spark, sf_dir):
    orders = standins.table(spark, sf_dir, "orders").select("o_orderkey")
    return splits.with_contiguous_fold(orders, "o_orderkey")


# A simple stand-in predictor: another ratio of the same counts.
_GUESS = "CAST(reactions + comments AS DOUBLE) / (impressions + 1)"


def _guessed(spark, sf_dir):
    guess = (F.col("reactions") + F.col("comments")).cast("double") / (F.col("impressions") + 1)
    return standins.posts(spark, sf_dir).withColumn("prediction", guess)


def _metrics_sql(source: str) -> str:
    return f"""SELECT count(*) AS n, {r('avg(abs(y - p))')} AS mae, {r('sqrt(avg((y - p) * (y - p)))')} AS rmse,
      {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2 FROM {source}"""


def _rounded_metrics(df):
    return df.select(*[rounded(c).alias(c) if c in ("mae", "rmse", "r2") else c for c in df.columns])


@register(
    "m10_regression_metrics",
    f"WITH {POSTS}, g AS (SELECT engagement_rate AS y, {_GUESS} AS p FROM posts) {_metrics_sql('g')}",
)
def m10_regression_metrics(spark, sf_dir):
    return _rounded_metrics(metrics.regression_metrics(_guessed(spark, sf_dir)))


@register(
    "m11_cross_validated_metrics",
    f"""WITH {POSTS}, g AS (SELECT CAST(floor(({_share('post_id')}) * 5) AS INTEGER) AS fold, engagement_rate AS y,
        {_GUESS} AS p FROM posts),
    f AS (SELECT fold, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse,
        1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM g GROUP BY fold)
    SELECT count(*) AS folds, {r('avg(r2)')} AS r2, {r('avg(mae)')} AS mae, {r('sqrt(avg(mse))')} AS rmse FROM f""",
)
def m11_cross_validated_metrics(spark, sf_dir):
    return _rounded_metrics(metrics.fold_metrics(splits.with_hash_fold(_guessed(spark, sf_dir), "post_id")))


@register(
    "m2_least_squares_line",
    f"""WITH {POSTS}, m AS (SELECT regr_slope(engagement_rate, impressions) AS a,
      regr_intercept(engagement_rate, impressions) AS b FROM posts)
    SELECT post_id, {r('a * impressions + b')} AS prediction FROM posts, m""",
)
def m2_least_squares_line(spark, sf_dir):
    df = models.assembler(["impressions"]).transform(standins.posts(spark, sf_dir))
    fitted = models.linear().fit(df.select("features", LABEL))
    return fitted.transform(df).select("post_id", rounded("prediction").alias("prediction"))


@register(
    "m4_ridge_line",
    f"""WITH {POSTS}, m AS (SELECT covar_pop(engagement_rate, impressions) / (var_pop(impressions) + 1.0 / count(*)) AS a,
      avg(engagement_rate) AS y, avg(impressions) AS x FROM posts)
    SELECT post_id, {r('y + a * (impressions - x)')} AS prediction FROM posts, m""",
)
def m4_ridge_line(spark, sf_dir):
    df = models.assembler(["impressions"]).transform(standins.posts(spark, sf_dir))
    fitted = RidgeRegression(labelCol=LABEL, alpha=1.0).fit(df.select("features", LABEL))
    return fitted.transform(df).select("post_id", rounded("prediction").alias("prediction"))


_STUMP = f"""WITH {POSTS}, cuts AS (SELECT DISTINCT weekday AS t FROM posts),
    s AS (SELECT t, sum(CASE WHEN weekday <= t THEN engagement_rate END) AS sl, count(CASE WHEN weekday <= t THEN 1 END) AS nl,
            sum(CASE WHEN weekday > t THEN engagement_rate END) AS sr, count(CASE WHEN weekday > t THEN 1 END) AS nr
          FROM posts CROSS JOIN cuts GROUP BY t),
    best AS (SELECT t, sl / nl AS l, sr / nr AS r FROM s WHERE nl > 0 AND nr > 0
             ORDER BY sl * sl / nl + sr * sr / nr DESC, t LIMIT 1)
    SELECT post_id, {r('CASE WHEN weekday <= t THEN best.l ELSE best.r END')} AS prediction FROM posts, best"""


def _stump(spark, sf_dir, estimator):
    df = models.assembler(["weekday"]).transform(standins.posts(spark, sf_dir))
    fitted = estimator.fit(df.select("features", LABEL))
    return fitted.transform(df).select("post_id", rounded("prediction").alias("prediction"))


@register("m3_weekday_stump", _STUMP)
def m3_weekday_stump(spark, sf_dir):
    return _stump(spark, sf_dir, models.tree(maxDepth=1))


@register("m5_one_tree_forest", _STUMP)
def m5_one_tree_forest(spark, sf_dir):
    """A forest of one tree on all rows is that tree."""
    return _stump(spark, sf_dir, models.forest(numTrees=1, maxDepth=1, maxBins=128, bootstrap=False))


@register("m6_one_step_of_boosting", _STUMP)
def m6_one_step_of_boosting(spark, sf_dir):
    """The first of boosted trees is fitted to the label itself."""
    one = models.boosted(maxIter=1, maxDepth=1, maxBins=128, subsamplingRate=1.0, featureSubsetStrategy="all")
    return _stump(spark, sf_dir, one)


@register(
    "a8_m13_pairs_of_a_line",
    f"""WITH {POSTS}, m AS (SELECT regr_slope(engagement_rate, impressions) AS a,
      regr_intercept(engagement_rate, impressions) AS b, min(engagement_rate) AS lo, max(engagement_rate) AS hi FROM posts)
    SELECT post_id, {r('engagement_rate')} AS actual, {r('a * impressions + b')} AS predicted, {r('lo')} AS low, {r('hi')} AS high
    FROM posts, m""",
)
def a8_m13_pairs_of_a_line(spark, sf_dir):
    """A saved least-squares bundle scores all posts: actual and predicted values, and the ends of the diagonal."""
    table = standins.posts(spark, sf_dir)
    fitted = models.pipeline(models.assembler(["impressions"]), models.linear()).fit(table)
    path = scratch.scratch_path(spark, "line")
    bundles.save_bundle(fitted, path)
    loaded = PipelineModel.load(f"{path}/model")
    scored = scratch.written(bundles.score(table, loaded).select("post_id", LABEL, "prediction"), "scores")
    ends = describe.identity_line(scored).select(F.struct("low", "high").alias("e")).scalar()
    pairs = describe.prediction_pairs(scored, "post_id").withColumn("e", ends)
    values = {"actual": "actual", "predicted": "predicted", "low": "e.low", "high": "e.high"}
    return pairs.select("post_id", *[rounded(F.col(c)).alias(n) for n, c in values.items()])


@register("m2_m3_baseline_models")
def m2_m3_baseline_models(spark, sf_dir):
    """Least squares and a depth-5 tree on four features, tested on held-out posts."""
    return training.baseline_models(standins.posts(spark, sf_dir))


@register("m4_text_ridge_model")
def m4_text_ridge_model(spark, sf_dir):
    """TF-IDF and numbers into ridge, fitted on the training part, tested on the rest."""
    return training.text_model(flows.posts_with_text(spark, sf_dir))


@register("m4_embedding_ridge_model")
def m4_embedding_ridge_model(spark, sf_dir):
    """Text vectors alone into ridge."""
    return training.embedding_model(flows.posts_with_text(spark, sf_dir))


_boards: dict = {}


def _board(spark, sf_dir, name):
    """The whole grid of one kind of model, searched once for each folder of tables in a session and stored."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _boards:
        table = training.tuning_table(flows.posts_with_text(spark, sf_dir))
        found = training.compare_models(table, {name: tuning.GRIDS[name]}, parallelism=tuning.FOLDS)
        _boards[key] = scratch.written(found, "board")
    return _boards[key]


def _shown(board):
    return board.select("model", F.map_entries("best_params").cast("string").alias("best_params"), "r2", "mae", "rmse")


@register("m8_ridge_grid_search")
def m8_ridge_grid_search(spark, sf_dir):
    board = _board(spark, sf_dir, "Ridge")
    return board.select("model", F.col("best_params")["alpha"].alias("alpha"), "r2", "mae", "rmse")


@register("m5_forest_search")
def m5_forest_search(spark, sf_dir):
    return _shown(_board(spark, sf_dir, "RandomForest"))


@register("m6_boosted_search")
def m6_boosted_search(spark, sf_dir):
    return _shown(_board(spark, sf_dir, "BoostedTrees"))


@register("m7_perceptron_search")
def m7_perceptron_search(spark, sf_dir):
    return _shown(_board(spark, sf_dir, "Perceptron"))


def _fold_sums(alphas):
    """SQL rows of closed-form ridge on one scaled number, per fold and penalty."""
    return f"""folds AS (SELECT f, a FROM (VALUES (0), (1), (2), (3), (4)) AS x(f), (VALUES {', '.join(f'({v})' for v in alphas)}) AS y(a)),
    t AS (SELECT f, a, avg(impressions) AS mx, stddev_pop(impressions) AS sx, avg(engagement_rate) AS my, count(*) AS n,
        covar_pop(impressions, engagement_rate) AS c
      FROM posts JOIN folds ON post_id % 5 <> f GROUP BY f, a),
    w AS (SELECT f, a, mx, sx, my, (n * c / sx) / (n + a) AS w FROM t),
    e AS (SELECT w.f, w.a, engagement_rate AS y, engagement_rate - (my + w * (impressions - mx) / sx) AS e
      FROM w JOIN posts ON post_id % 5 = w.f),
    m AS (SELECT f, a, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, avg(abs(e)) AS mae, avg(e * e) AS mse FROM e GROUP BY f, a)"""


@register(
    "m8_m12_ridge_search_on_one_number",
    f"""WITH {POSTS}, {_fold_sums(tuning.GRIDS['Ridge']['alpha'])},
    b AS (SELECT a, avg(r2) AS r2, avg(mae) AS mae, sqrt(avg(mse)) AS rmse FROM m GROUP BY a)
    SELECT 'Ridge' AS model, CAST(a AS DOUBLE) AS alpha, {r('r2')} AS r2, {r('mae')} AS mae, {r('rmse')} AS rmse
    FROM b ORDER BY b.r2 DESC LIMIT 1""",
)
def m8_m12_ridge_search_on_one_number(spark, sf_dir):
    """The search with its scaling, folds and metrics, on one number that SQL can follow."""
    posts = standins.posts(spark, sf_dir).withColumn("fold", (F.col("post_id") % 5).cast("int"))
    table = models.assembler(["impressions"]).transform(posts).select("post_id", "features", LABEL, "fold")
    board = training.compare_models(scratch.written(table, "posts"), {"Ridge": tuning.GRIDS["Ridge"]})
    return board.select(
        "model", F.col("best_params")["alpha"].cast("double").alias("alpha"),
        *[rounded(c).alias(c) for c in ("r2", "mae", "rmse")],
    )


@register("m12_leaderboard")
def m12_leaderboard(spark, sf_dir):
    """All four kinds of model by cross-validated R2, best first."""
    boards = [_board(spark, sf_dir, name) for name in tuning.GRIDS]
    return _shown(reduce(DataFrame.unionByName, boards)).orderBy(F.col("r2").desc(), "model")


def _tested_posts(spark, sf_dir):
    rows = relational.fill_numeric(standins.posts(spark, sf_dir), features.TUNING)
    return splits.split(scratch.written(rows.select("post_id", *features.TUNING, LABEL), "posts"), "post_id")


@register("m7_perceptron")
def m7_perceptron(spark, sf_dir):
    """Perceptron on scaled numbers, tested on held-out posts."""
    train, test = _tested_posts(spark, sf_dir)
    scaler = PopulationScaler(inputCols=list(features.TUNING), outputCol="features")
    return training.evaluated(train, test, [scaler, PerceptronRegressor(labelCol=LABEL)], "Perceptron")


@register("m7_perceptron_beats_a_line", "SELECT true AS better")
def m7_perceptron_beats_a_line(spark, sf_dir):
    """On the posts it learns from, a perceptron explains more than least squares on the same numbers."""
    train, _ = _tested_posts(spark, sf_dir)
    scaler = PopulationScaler(inputCols=list(features.TUNING), outputCol="features")
    fits = [
        training.evaluated(train, train, [scaler, e], n)
        for e, n in ((PerceptronRegressor(labelCol=LABEL), "Perceptron"), (models.linear(), "LinearRegression"))
    ]
    r2 = [F.max(F.when(F.col("model") == n, F.col("r2"))) for n in ("Perceptron", "LinearRegression")]
    return fits[0].unionByName(fits[1]).agg((r2[0] > r2[1]).alias("better"))


_bundles: dict = {}


def scoring_bundle(spark, sf_dir):
    """Table, the full-size scorer on its training part, and its description.

    Fitted once for each folder of tables in a session, and saved; the queries that use it read it back. The table is
    dealt by post: the join leaves posts without a text, most of them, in few pieces, and scoring works by the row.
    """
    table = flows.scoring_table(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _bundles:
        path = scratch.scratch_path(spark, "bundle")
        training.train_scorer(scratch.written(table, "scoring-table"), path)
        _bundles[key] = path
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(pieces, "post_id"), *bundles.load_bundle(spark, _bundles[key])


@register("m13_train_scorer")
def m13_train_scorer(spark, sf_dir):
    """The scorer at its real size: fitted on the training part, measured on the rest."""
    table, fitted, _ = scoring_bundle(spark, sf_dir)
    _, test = splits.split(table, "post_id")
    return metrics.regression_metrics(bundles.score(test, fitted))


@register(
    "e9_preprocessor_scales",
    f"WITH {POSTS} "
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS feature, {r(f'avg({c})')} AS mean, "
        f"{r(f'stddev_pop({c})')} AS deviation, 396 AS expected_dim FROM posts"
        for i, c in enumerate(standins.METRICS)
    ),
)
def e9_preprocessor_scales(spark, sf_dir):
    """What the preprocessor learnt of each number, with the width it was built for."""
    model, about = bundles.fit_preprocessor(flows.scoring_table(spark, sf_dir))
    scaler = model.stages[0]
    learnt = zip(scaler.getInputCols(), scaler.getOrDefault("means"), scaler.getOrDefault("deviations"))
    rows = [(i, name, mean, deviation) for i, (name, mean, deviation) in enumerate(learnt)]
    scales = spark.createDataFrame(rows, "position int, feature string, mean double, deviation double")
    width = about.select("expected_dim").scalar()
    return scales.select(
        "position", "feature", rounded("mean").alias("mean"), rounded("deviation").alias("deviation"),
        width.alias("expected_dim"),
    )


@register("e3_assembled_widths", f"WITH {JOINED} SELECT 396 AS width, count(*) AS n_rows FROM joined")
def e3_assembled_widths(spark, sf_dir):
    """Numbers, category flags and text vector side by side; the width is checked."""
    table = flows.scoring_table(spark, sf_dir)
    preprocessor, _ = bundles.fit_preprocessor(table)
    widths = preprocessor.transform(table).select(F.size(vector_to_array("features")).alias("width"))
    return widths.groupBy("width").agg(F.count(F.lit(1)).alias("n_rows"))


@register("m13_batch_scores")
def m13_batch_scores(spark, sf_dir):
    table, fitted, _ = scoring_bundle(spark, sf_dir)
    return bundles.score(table, fitted).select("post_id", LABEL, "prediction")


@register("a8_prediction_pairs")
def a8_prediction_pairs(spark, sf_dir):
    """Actual and predicted rate of every post, with the ends of the diagonal."""
    table, fitted, _ = scoring_bundle(spark, sf_dir)
    scored = scratch.written(bundles.score(table, fitted).select("post_id", LABEL, "prediction"), "scores")
    line = describe.identity_line(scored)
    ends = line.select(F.struct("low", "high").alias("e")).scalar()
    pairs = describe.prediction_pairs(scored, "post_id").withColumn("e", ends)
    return pairs.select("post_id", "actual", "predicted", F.col("e.low").alias("low"), F.col("e.high").alias("high"))


@register("s7_saved_bundle", f"WITH {JOINED} SELECT post_id, true AS same FROM joined")
def s7_saved_bundle(spark, sf_dir):
    """A bundle read back from storage predicts what the fitted one does."""
    table, fitted, about = scoring_bundle(spark, sf_dir)
    path = scratch.scratch_path(spark, "bundle")
    bundles.save_bundle(fitted, path, about)
    loaded, _ = bundles.load_bundle(spark, path)
    before = bundles.score(table, fitted).select("post_id", F.col("prediction").alias("p"))
    after = bundles.score(table, loaded).select("post_id", F.col("prediction").alias("q"))
    return before.join(after, "post_id").select("post_id", (F.col("p") == F.col("q")).alias("same"))
