"""Whitening against exact covariances and known eigenvectors."""

import math

import numpy as np
import pytest

from resonance.llm import whitening

SPECTRA = {
    "spread": np.linspace(0.1, 5, 40),
    "falling": np.logspace(-8, 0, 40),
    "equal": np.ones(40),
    "clusters": np.r_[1 + 1e-9 * np.arange(10), 2 + 1e-7 * np.arange(10), 3 + 1e-12 * np.arange(10), 4, 4, 4, 5, 6, 7, 7.5, 8, 9, 10],
}


def with_values(values, seed=0):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (3 * np.eye(n) - q.T @ q) / 2
    a = (q * np.asarray(values, np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors_to_double_precision(name):
    a, _ = with_values(SPECTRA[name])
    values, vectors = whitening.eigen(a)
    size = float(np.abs(a).max())
    assert np.abs(a @ vectors - vectors * values).max() < 4e-16 * len(a) * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-14
    assert np.allclose(values, np.sort(np.asarray(SPECTRA[name], float))[::-1], rtol=1e-15, atol=1e-16 * size)


def test_vectors_of_close_values_are_told_apart():
    values = np.r_[1 + 1e-9 * np.arange(8), np.linspace(2, 3, 12)]
    a, q = with_values(values)
    _, vectors = whitening.eigen(a)
    order = np.argsort(-values)
    # float32 alone can't tell the eight apart, double precision leaves an error near 1e-16 / 1e-9.
    assert np.abs(np.abs(vectors) - np.abs(q[:, order]).astype(float)).max() < 1e-9


def fit(spark, rows, schema="vec_id long, embedding array<float>, label int, x string, component int", **kw):
    frame = spark.createDataFrame(rows, schema).repartition(3)
    return whitening.whiten(frame, **kw).collect()


def exact(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    y = x * n - s
    v = (y.T @ y).astype(float) / n**3
    return n, [int((r**2).sum()) for r in y], v, y.astype(float) / n


def test_rows_equal_exact_arithmetic(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(200, 12)) * np.linspace(0.2, 3, 12)
    vectors[:, 5] = 0.25  # without spread
    vectors[:, 6] = vectors[:, 7]
    vectors[3] = vectors[4]
    ids = [2**60 + i for i in range(199)] + [None]
    odd = [(900, None), (901, []), (902, [1.0] * 11), (903, [None] + [1.0] * 11), (904, [float("nan")] + [1.0] * 11),
           (905, [float("inf")] * 12)]
    rows = [(i, list(map(float, v)), 1, "x", 7) for i, v in zip(ids, vectors)] + [(i, v, None, None, None) for i, v in odd]
    got = fit(spark, rows)
    n, deviations, v, y = exact(vectors)
    e, w = np.linalg.eigh(v)
    k = 10
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    place = {i: j for j, i in enumerate(ids)}
    table = np.zeros((n, k))
    for r in got:
        j = place[r["vec_id"]]
        assert r["deviation"] == deviations[j]
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(v)) < 1e-12
        table[j, r["component"] - 1] = r["whitened"]
    want = y @ w / np.sqrt(e)
    sign = np.sign((table * want).sum(axis=0))
    assert np.abs(table * sign - want).max() < 1e-9
    assert got[0]["identity_error"] < 1e-12


def test_at_most_as_many_components_as_asked(spark):
    rng = np.random.default_rng(5)
    rows = [(i, list(map(float, v)), 1, "x", 7) for i, v in enumerate(rng.normal(size=(90, 40)))]
    assert {r["component"] for r in fit(spark, rows)} == set(range(1, 33))
    assert {r["component"] for r in fit(spark, rows, components=3)} == {1, 2, 3}


def test_no_rows_and_no_spread(spark):
    assert fit(spark, [(1, None, 1, "x", 7)]) == []
    assert fit(spark, [(i, [0.5, 0.5], 1, "x", 7) for i in range(9)]) == []


def test_large_entries_do_not_crash(spark):
    rows = [(i, [3e38 if i == 3 else float(i), float(i * i % 7)], 1, "x", 7) for i in range(9)]
    got = fit(spark, rows)
    assert {r["deviation"] for r in got} == {None} or all(r["deviation"] is None or r["deviation"] >= 0 for r in got)


def test_given_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    pdf = frame.toPandas()
    n, deviations, v, y = exact(pdf["embedding"])
    got = whitening.whiten(frame).toPandas().sort_values(["vec_id", "component"])
    e, w = np.linalg.eigh(v)
    want = (y @ w[:, ::-1][:, :32] / np.sqrt(e[::-1][:32]))[np.argsort(pdf["vec_id"].to_numpy())]
    assert np.abs(np.abs(got["whitened"].to_numpy().reshape(n, 32)) - np.abs(want)).max() < 1e-9
    assert got["identity_error"].max() < 1e-12 and got["deviation"].iloc[0] == dict(zip(pdf["vec_id"], deviations))[got["vec_id"].iloc[0]]
