import numpy as np
import pytest
from pyspark.sql import functions as F

from resonance.operators import describe, quantiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def columns(kind):
    rng = np.random.default_rng(3)
    if kind == "skewed":  # one group and one value hold most rows
        v = np.concatenate([np.full(4000, 7.0), rng.lognormal(0, 2, 1500)])
        g = np.where(rng.random(len(v)) < 0.8, 0, rng.integers(1, 6, len(v)))
    elif kind == "distinct":
        v, g = rng.normal(size=5000), rng.integers(0, 3, 5000)
    else:
        v, g = np.array([5.0, 5.0, 1.0]), np.array([0, 0, 1])
    return g, v


@pytest.mark.parametrize("kind", ["skewed", "distinct", "tiny"])
@pytest.mark.parametrize("accuracy", [10_000, 10])  # 10: brackets far too wide, still exact
@pytest.mark.parametrize("groups", [None, 10])
def test_percentiles_are_exact(spark, kind, accuracy, groups):
    g, v = columns(kind)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double").repartition(5)
    got = {(r["g"], r["prob"]): r["quantile"]
           for r in quantiles.exact_percentiles(df, ["g"], "v", PROBS, groups, accuracy).collect()}
    want = {(int(a), p): float(np.quantile(v[g == a], p)) for a in np.unique(g) for p in PROBS}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_percentiles_of_the_whole_table_skip_nulls(spark):
    df = spark.range(101).select(F.when(F.col("id") < 100, F.col("id").cast("double")).alias("v"))
    got = {r["prob"]: r["quantile"] for r in quantiles.exact_percentiles(df, [], "v", (0.25, 0.5)).collect()}
    assert got == {0.25: 24.75, 0.5: 49.5}


def test_percentiles_of_an_empty_table(spark):
    df = spark.range(0).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact_percentiles(df, [], "v", (0.5,)).collect() == []


def test_histogram_matches_numpy(spark):
    rows = describe.histogram(spark.range(101), "id", 30).orderBy("bin").collect()
    want, edges = np.histogram(np.arange(101), 30)
    assert [r["n"] for r in rows] == want.tolist()
    assert np.allclose([r["left_edge"] for r in rows], edges[:-1])


def test_histogram_of_a_constant(spark):
    rows = describe.histogram(spark.range(4).select(F.lit(3.0).alias("c")), "c", 10).orderBy("bin").collect()
    assert sum(r["n"] for r in rows) == 4 and (rows[0]["left_edge"], rows[-1]["right_edge"]) == (2.5, 3.5)


def test_density_has_the_area_of_the_histogram(spark):
    df = spark.range(1000).select((F.col("id") % 50).cast("double").alias("v"))
    rows = describe.kde(df, "v", 200, 30).orderBy("grid").collect()
    x, d = np.array([r["x"] for r in rows]), np.array([r["density"] for r in rows])
    v = np.arange(1000) % 50
    h = v.std(ddof=1) * 1000 ** -0.2
    want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (h * np.sqrt(2 * np.pi)) * 49 / 30
    assert np.allclose(d, want)


def test_box_of_a_group_with_outliers(spark):
    data = [(0, float(v)) for v in [1, 2, 3, 4, 5, 100]] + [(1, 2.0)] + [(None, 1.0)]
    rows = {r["g"]: r for r in describe.box_stats(spark.createDataFrame(data, "g int, v double"), "g", "v").collect()}
    assert set(rows) == {0, 1}
    assert (rows[0]["q1"], rows[0]["median"], rows[0]["q3"]) == (2.25, 3.5, 4.75)
    assert (rows[0]["whisker_low"], rows[0]["whisker_high"], rows[0]["outliers"]) == (1.0, 5.0, 1)
    assert (rows[1]["q1"], rows[1]["whisker_high"], rows[1]["outliers"]) == (2.0, 2.0, 0)


def test_sketched_summary_is_close(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"))
    exact = describe.describe_numeric(df, ["a"]).first()
    rough = describe.describe_numeric_approx(df, ["a"]).first()
    assert abs(exact["p50"] - rough["p50"]) <= 1 and exact["std"] == rough["std"] and exact["count"] == 1000
