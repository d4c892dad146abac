from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonance.explain import trees, words
from resonance.learning import bundle, models
from tests.test_learning import scoring_rows


def data(spark, n=200):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(n, 4)).astype(float)
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 2, 5, 0)
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, engagement_rate double")
    return x, models.assembler(list("abcd")).transform(df)


def conditional_expectation(nodes, tree, node, row, known):
    n = nodes[tree, node]
    if n["leftChild"] < 0:
        return n["prediction"]
    if n["feature"] in known:
        side = "leftChild" if row[n["feature"]] <= n["threshold"] else "rightChild"
        return conditional_expectation(nodes, tree, n[side], row, known)
    return sum(nodes[tree, n[s]]["cover"] / n["cover"] * conditional_expectation(nodes, tree, n[s], row, known)
               for s in ("leftChild", "rightChild"))


def brute_force(nodes, row, width):
    """Shapley values from their definition, over all subsets of features."""
    weight = {t: nodes[t, 0]["weight"] for t, i in nodes if i == 0}
    value = lambda known: sum(w * conditional_expectation(nodes, t, 0, row, known) for t, w in weight.items())
    out = []
    for i in range(width):
        others = [j for j in range(width) if j != i]
        out.append(sum(
            factorial(k) * factorial(width - k - 1) / factorial(width) * (value({*s, i}) - value(set(s)))
            for k in range(width) for s in combinations(others, k)))
    return out


@pytest.mark.parametrize("kind, settings", [
    (models.tree, {"maxDepth": 4}), (models.forest, {"numTrees": 3, "maxDepth": 3}), (models.boosted, {"maxIter": 3, "maxDepth": 3})])
def test_attributions_match_the_definition_and_add_up(spark, kind, settings):
    x, df = data(spark)
    model = kind(**settings).fit(df)
    nodes = {(r["tree"], r["id"]): r for r in trees.tree_nodes(spark, model).collect()}
    rows = trees.tree_shap_wide(model.transform(df), model, ["id", "prediction"]).collect()
    assert len(rows) == len(x)
    for r in rows:
        assert abs(r["base"] + sum(r["shap"]) - r["prediction"]) < 1e-9
    for r in rows[:5]:
        assert np.allclose(r["shap"], brute_force(nodes, x[r["id"]], 4))


def test_long_form_and_importance(spark):
    _, df = data(spark)
    model = models.tree(maxDepth=3).fit(df)
    long = trees.tree_shap(df, model, ["id"], list("abcd"), first=2)
    assert long.count() == 400 and {r[0] for r in long.select("feature").distinct().collect()} == {"a", "b"}
    top = trees.global_importance(trees.tree_shap(df, model, ["id"], list("abcd")), 3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[1]["importance"] >= top[2]["importance"]


def test_word_contributions_sum_to_zero_per_post(spark):
    df = scoring_rows(spark)
    preprocessor, _ = bundle.fit_preprocessor(df)
    fitted = bundle.fit_bundle(preprocessor, df, models.boosted(maxIter=3, maxDepth=3))
    out = words.word_influence(df, fitted)
    assert out.count() == 40 * 3
    sums = out.groupBy("post_id").agg(F.abs(F.sum("contribution")).alias("s"), F.max("opacity").alias("o")).collect()
    assert len(sums) == 40 and all(r["s"] < 1e-9 and r["o"] <= 1.0 for r in sums)


def test_keyword_influence_finds_the_word_that_matters(spark):
    rows = [(f"{'great' if i % 2 else 'dull'} post number{i % 5}", 1.0 + i % 2) for i in range(40)] + [("great", 0.0), (None, 5.0)]
    table = words.keyword_influence(spark.createDataFrame(rows, "post_text string, engagement_rate double"))
    top = table.orderBy(F.col("influence").desc()).first()
    assert top["keyword"].startswith("great") and top["influence"] > 0
    weights = {r["keyword"]: r["influence"] for r in table.collect()}
    assert weights["dull"] < 0 < weights["great"]


def wide(spark, n=400, d=14):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d)).round(1)
    y = x[:, 0] * x[:, 1] + x[:, 2] + np.abs(x[:, 3]) + x @ rng.normal(size=d) / 3
    names = [f"c{i}" for i in range(d)]
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["id", *names, "engagement_rate"])
    return x, models.assembler(names).transform(df)


def test_deep_trees_are_explained_like_shallow_ones(spark, monkeypatch):
    x, df = wide(spark)
    model = models.forest(numTrees=4, maxDepth=30).fit(df)
    leaves, deep, base = trees.explained(spark, model)
    assert len(deep) == 4 and not leaves
    some = x[:40]
    got = trees.attributions(some, leaves, deep, [])
    predicted = np.array([r["prediction"] for r in model.transform(df).orderBy("id").collect()])[:40]
    assert np.abs(base + got.sum(axis=1) - predicted).max() < 1e-9
    # The same trees by tables of all patterns.
    monkeypatch.setattr(trees, "TABLED", 20)
    leaves, deep, _ = trees.explained(spark, model)
    assert not deep and max(len(leaf.features) for leaf in leaves) > 8
    assert np.allclose(got, trees.attributions(some, leaves, [], trees.payment_tables(leaves)), atol=1e-10)


def test_walk_equals_the_definition_on_small_trees(spark, monkeypatch):
    x, df = data(spark)
    monkeypatch.setattr(trees, "TABLED", 0)
    monkeypatch.setattr(trees, "WALKERS", 7)
    model = models.boosted(maxIter=3, maxDepth=5).fit(df)
    nodes = {(r["tree"], r["id"]): r for r in trees.tree_nodes(spark, model).collect()}
    leaves, deep, base = trees.explained(spark, model)
    assert len(deep) == 3
    got = trees.attributions(x[:12], leaves, deep, [])
    for row, shap in zip(x[:12], got):
        assert np.allclose(shap, brute_force(nodes, row, 4))


@pytest.mark.parametrize("kind, settings", [
    (models.boosted, {"maxIter": 4, "maxDepth": 3}), (models.forest, {"numTrees": 3, "maxDepth": 8}), (models.tree, {"maxDepth": 9}),
    (models.linear, {})])
def test_word_scores_equal_those_of_whole_rows(spark, kind, settings):
    rng = np.random.default_rng(2)
    names = [f"word{i}" for i in range(60)]
    rows = [(i, int(rng.integers(0, 9)), int(rng.integers(0, 5)), 1, 1, 0, " ".join(rng.choice(names, 6)),
             ["Poll", "Reel", None][i % 3], float(rng.normal())) for i in range(300)]
    rows += [(300, 5, 1, None, 1, 0, "the fox  fox and", "Poll", 0.5), (301, 1, 1, 1, 1, 1, " ", "Poll", 0.5)]
    df = spark.createDataFrame(rows, "post_id long, impressions long, reactions long, comments long, reposts long, "
                                     "saves long, post_text string, post_type string, engagement_rate double")
    preprocessor, _ = bundle.fit_preprocessor(df)
    fitted = bundle.fit_bundle(preprocessor, df, kind(**settings))
    got = {(r["post_id"], r["pos"]): (r["word"], r["score"]) for r in words.word_scores(df, fitted).collect()}
    assert len(got) == 300 * 6 + 4
    each = [(i, p, w) for i, *_, text, _, _ in rows if text.strip() for p, w in enumerate(text.split())]
    alone = spark.createDataFrame(each, "post_id long, pos int, word string").join(df, "post_id").drop("post_text")
    want = bundle.score(alone.withColumnRenamed("word", "post_text"), fitted).collect()
    for r in want:
        word, score = got[r["post_id"], r["pos"]]
        assert word == r["post_text"] and abs(score - r["prediction"]) < 1e-9


@pytest.mark.parametrize("kind_bytes, at_once", [(32 << 20, 1000), (32 << 20, 40), (0, 1000)])
def test_a_post_is_one_row_where_words_are_of_few_kinds(spark, monkeypatch, kind_bytes, at_once):
    rng = np.random.default_rng(6)
    names = [f"word{i}" for i in range(50)]
    rows = [(i if i < 28 else None, 1, 2, 1, 1, 0, " ".join(rng.choice(names, 7)), "Poll", float(rng.normal())) for i in range(30)]
    rows.append((3, 1, 2, 1, 1, 0, "word1 word2 word1", "Poll", 0.1))  # another text of post 3
    df = spark.createDataFrame(rows, "post_id long, impressions long, reactions long, comments long, reposts long, "
                                     "saves long, post_text string, post_type string, engagement_rate double")
    preprocessor, _ = bundle.fit_preprocessor(df)
    fitted = bundle.fit_bundle(preprocessor, df, models.boosted(maxIter=3, maxDepth=4))
    kept = []
    monkeypatch.setattr(words, "KIND_BYTES", kind_bytes)
    monkeypatch.setattr(words, "AT_ONCE", at_once)
    monkeypatch.setattr(words, "written", lambda d, label, whole=words.written: kept.append((label, d)) or whole(d, label))
    got = sorted((r["post_id"], r["pos"], r["word"], round(r["score"], 9)) for r in words.word_scores(df, fitted).collect())
    text = {(i, t): [r for r in rows if r[0] == i and r[6] == t][0] for i, t in {(r[0], r[6]) for r in rows} if i is not None}
    each = [(i, p, w, *r[1:6], w, *r[7:]) for (i, t), r in text.items() for p, w in enumerate(t.split())]
    alone = spark.createDataFrame(each, "post_id long, pos int, word string, impressions long, reactions long, comments long, "
                                        "reposts long, saves long, post_text string, post_type string, engagement_rate double")
    want = sorted((r["post_id"], r["pos"], r["word"], round(r["prediction"], 9)) for r in bundle.score(alone, fitted).collect())
    assert got == want and len(got) == 28 * 7 + 3
    labels = [label for label, _ in kept]
    assert ("pair-scores" in labels) == (not kind_bytes) and labels.count("word-scores-part") == (6 if at_once == 40 else 0)


def test_keywords_equal_the_closed_form(spark):
    """Two words, by hand: tf-idf vectors of unit length, then the ridge equations."""
    texts = ["alpha", "alpha alpha beta", "beta", "beta gamma beta", "alpha gamma"] * 3
    rates = [float(1 + i % 4 + (i % 5) / 3) for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(texts, rates)), "post_text string, engagement_rate double")
    for size in (1, 2):
        got = {r["keyword"]: r["influence"] for r in words.keyword_influence(df, size=size, alpha=0.7).collect()}
        counts = np.array([[t.split().count(w) for w in ("alpha", "beta")] for t in texts], float)
        idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1
        kept = [0, 1] if size == 2 else [int(counts.sum(axis=0).argmax())]
        x = (counts * idf)[:, kept]
        norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        xc, yc = x - x.mean(0), np.array(rates) - np.mean(rates)
        want = np.linalg.solve(xc.T @ xc + 0.7 * np.eye(len(kept)), xc.T @ yc)
        assert np.allclose([got[w] for w in np.array(["alpha", "beta"])[kept]], want, atol=1e-9)
