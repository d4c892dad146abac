import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from resonance.learning import bundle, metrics, models, perceptron, splits, stages, tuning


def labelled(spark, n=120, width=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * np.array([1, 5, 0.1, 2, 1, 1])[:width]
    x[:, -1] = 4.0  # constant
    y = x[:, 0] * 2 - x[:, 1] + 3 + rng.normal(size=n)
    rows = [(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["id", "features", "label"]).repartition(3)


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_ridge_equals_the_closed_form(spark, alpha):
    x, y, df = labelled(spark)
    xc, yc = x[:, :-1] - x[:, :-1].mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(xc.shape[1]), xc.T @ yc)
    model = stages.RidgeRegression(alpha=alpha).fit(df)
    assert np.allclose(stages.ridge_weights(model, 6), [*want, 0.0], atol=1e-8)
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], xc @ want + y.mean(), atol=1e-8)


def test_ridge_is_saved_and_read(spark, tmp_path):
    _, _, df = labelled(spark)
    model = PipelineModel([stages.RidgeRegression(alpha=2.0).fit(df)])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    pick = lambda m: sorted((r["id"], r["prediction"]) for r in m.transform(df).collect())
    assert pick(model) == pick(again)


def test_split_and_folds_cover_every_row_once(spark):
    df = spark.range(1000)
    train, test = splits.split(df, "id")
    assert train.count() + test.count() == 1000 and train.join(test, "id").count() == 0
    assert 150 < test.count() < 250
    assert sorted(r["id"] for r in splits.split(df.repartition(7), "id")[1].collect()) == sorted(r["id"] for r in test.collect())
    assert {r[0] for r in splits.with_hash_fold(df, "id").select("fold").distinct().collect()} == set(range(5))


@pytest.mark.parametrize("n", [203, 5, 3, 1])
def test_contiguous_folds(spark, n):
    rows = splits.with_contiguous_fold(spark.range(n).select((F.col("id") * 3).alias("k")).repartition(4), "k").collect()
    got = [r["fold"] for r in sorted(rows, key=lambda r: r["k"])]
    assert got == [i for i, part in enumerate(np.array_split(np.arange(n), 5)) for _ in part]


def test_metrics_of_labels_without_spread(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0), (1, 2.0, 2.0), (2, 2.0, 3.0), (2, 2.0, 2.0)], "g int, y double, p double")
    got = {r["g"]: r["r2"] for r in metrics.regression_metrics(df, "y", "p", ["g"]).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_metrics_far_from_zero(spark):
    y = 1e9 + np.arange(50.0)
    p = y + np.where(np.arange(50) % 2, 0.5, -0.5)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    got = metrics.regression_metrics(df, "y", "p").first()
    assert abs(got["r2"] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_grid_search_matches_a_manual_loop(spark):
    x, y, df = labelled(spark)
    df = splits.with_contiguous_fold(df, "id").persist()
    found = tuning.grid_search(df, "Ridge", {"alpha": [0.1, 200.0]}, stages.RidgeRegression(labelCol="label"))
    r2, mae, mse = [], [], []
    for part in np.array_split(np.arange(len(y)), 5):
        rest = np.setdiff1d(np.arange(len(y)), part)
        m, s = x[rest].mean(0), x[rest].std(0)
        s[s == 0] = 1
        a, b = (x[rest] - m) / s, (x[part] - m) / s
        w = np.linalg.solve(a.T @ a + 0.1 * np.eye(6), a.T @ (y[rest] - y[rest].mean()))
        e = y[part] - (b @ w + y[rest].mean())
        r2.append(1 - (e**2).sum() / ((y[part] - y[part].mean()) ** 2).sum())
        mae.append(np.abs(e).mean())
        mse.append((e**2).mean())
    assert found["best_params"] == {"alpha": 0.1}
    assert np.allclose([found["r2"], found["mae"], found["rmse"]], [np.mean(r2), np.mean(mae), np.mean(mse) ** 0.5])
    board = metrics.leaderboard(spark, [found, {**found, "model": "Other", "r2": 2.0}]).collect()
    assert [r["model"] for r in board] == ["Other", "Ridge"] and board[1]["best_params"] == {"alpha": "0.1"}


def test_perceptron_gradient_is_the_slope_of_its_loss():
    rng = np.random.default_rng(0)
    sizes, x, y = [3, 4, 2, 1], rng.normal(size=(9, 3)), rng.normal(size=9)
    flat = perceptron.initial_weights(sizes, 1)
    g, _ = perceptron.gradient(x, y, flat, sizes)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (perceptron.gradient(x, y, flat + s * step, sizes)[1] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_perceptron_does_not_depend_on_partitions(spark, tmp_path):
    _, _, df = labelled(spark, 60)
    fit = lambda d: perceptron.PerceptronRegressor(hidden=[5], maxIter=4).fit(d)
    few, many = fit(df.coalesce(1)), fit(df.repartition(20))  # 20 is past the combiners
    assert np.allclose(few.getOrDefault("weights"), many.getOrDefault("weights"), atol=1e-9)
    few.write().overwrite().save(str(tmp_path / "p"))
    again = perceptron.PerceptronModel.load(str(tmp_path / "p"))
    assert [r["prediction"] for r in again.transform(df).collect()] == [r["prediction"] for r in few.transform(df).collect()]


def scoring_rows(spark):
    rows = [(i, i % 7, i % 3, i % 2, 1, 0, ["fox jumps high", "lazy dog sleeps", "  "][i % 3], ["Poll", "Reel", None][i % 3],
             (i % 7) / 7) for i in range(60)]
    return spark.createDataFrame(rows, "post_id long, impressions long, reactions long, comments long, reposts long, "
                                       "saves long, post_text string, post_type string, engagement_rate double")


def test_bundle_scores_the_same_after_saving(spark, tmp_path):
    df = scoring_rows(spark)
    preprocessor, about = bundle.fit_preprocessor(df)
    fitted = bundle.fit_bundle(preprocessor, df, models.boosted(maxIter=2, maxDepth=2))
    bundle.save_bundle(fitted, str(tmp_path / "b"), about)
    loaded, record = bundle.load_bundle(spark, str(tmp_path / "b"))
    assert record.first()["expected_dim"] == 5 + 7 + 384
    pick = lambda m, **k: sorted((r["post_id"], r["prediction"]) for r in bundle.score(df, m, **k).collect())
    assert pick(fitted) == pick(loaded)
    assert len(pick(fitted, skip_blank="post_text")) == 40


def test_vector_of_another_width_is_an_error(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)], ["v"])
    with pytest.raises(Exception, match="VectorSizeHint|size"):
        models.size_guard("v", 3).transform(df).collect()


def test_registered_searches_try_every_setting(spark, monkeypatch):
    from resonance.catalog import learning
    from resonance.catalog.common import QUERIES

    searched = {}

    def compare(table, grids, parallelism):
        searched.update(grids)
        rows = [(name, {"k": "v"}, 0.5, 0.1, 0.2) for name in grids]
        return spark.createDataFrame(rows, "model string, best_params map<string,string>, r2 double, mae double, rmse double")

    monkeypatch.setattr(learning, "_boards", {})
    monkeypatch.setattr(learning.flows, "posts_with_text", lambda *_: None)
    monkeypatch.setattr(learning.training, "tuning_table", lambda *_: None)
    monkeypatch.setattr(learning.training, "compare_models", compare)
    for name, kind in (("m5_forest_search", "RandomForest"), ("m6_boosted_search", "BoostedTrees"), ("m7_perceptron_search", "Perceptron")):
        searched.clear()
        assert [r["model"] for r in QUERIES[name](spark, "none").collect()] == [kind]
        assert searched == {kind: learning.tuning.GRIDS[kind]}
    assert {r["model"] for r in learning.m12_leaderboard(spark, "none").collect()} == set(learning.tuning.GRIDS)
