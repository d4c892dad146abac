"""Steps whose cost must not outgrow the input."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from resonance.learning import bundle, growing, searches
from resonance.operators import features
from resonance.sources import workbook
from resonance.sources.workbook_sink import workbook_bytes


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_length_of_a_vector_reads_stored_entries_only(spark):
    rows = [(1, Vectors.sparse(9, [2, 5], [3.0, 4.0])), (2, Vectors.dense([6.0, 8.0])), (3, Vectors.sparse(3, [], []))]
    df = spark.createDataFrame(rows, ["id", "v"]).select("id", features.vector_norm("v").alias("n"))
    assert {r["id"]: r["n"] for r in df.collect()} == {1: 5.0, 2: 10.0, 3: 0.0}
    assert "UDF" not in plan_of(df)


def test_many_small_workbooks_are_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"PostAnalytics_{i}.xlsx").write_bytes(workbook_bytes([(0, 0, "a"), (0, 1, str(i))]))
    (tmp_path / "PostAnalytics_bad.xlsx").write_bytes(b"no workbook")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        cells = workbook.read_sheet_cells(spark, str(tmp_path))
        assert cells.rdd.getNumPartitions() <= 16 * spark.sparkContext.defaultParallelism
        good, bad = workbook.split_bad_files(cells)
        assert good.count() == 200 and bad.count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


TEXTS = [(1, "Red fox, red FOX"), (2, "fox the red"), (3, None), (4, ""), (None, "red"), (1, "fox")]


def test_vocabulary_counts_before_rows_leave_a_batch(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string").repartition(3)
    found = features.vocabulary(df, "text", 10)
    want = {("red", 4, 3), ("fox", 4, 3), ("red fox", 2, 1), ("fox red", 2, 2)}
    assert {(r["term"], r["tf"], r["df"]) for r in found.collect()} == want
    assert "Generate" not in plan_of(found)
    assert {r["term"] for r in features.vocabulary(df, "text", 10, ngrams=1).collect()} == {"red", "fox"}


def test_weights_of_terms_look_at_each_text_once(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    found = features.tfidf_long(df, "id", "text")
    assert plan_of(found).count(" AS _tokens#") == 2  # the vocabulary, the weights
    lengths = found.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert sorted((r["id"], round(r["n"], 9)) for r in lengths) == [(1, 1.0), (2, 1.0)]


def test_rows_of_a_scorer_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(bundle, "AS_IT_IS", 10)
    rows = bundle.dealt(spark.range(1000).coalesce(1).persist())
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 500
    rows.unpersist()


def test_gradients_come_from_a_task_for_each_core_at_most(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(searches, "LEAST_ROWS", 1)
    monkeypatch.setattr(searches, "train", lambda rows, tasks, *_: seen.append(rows.rdd.getNumPartitions()) or [None] * len(tasks))
    rows = [(Vectors.dense([float(i), float(i % 7)]), float(i), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, ["x", "y", "fold"]).repartition(20)
    searches.fit_perceptrons(df, {"hidden": [[2]], "alpha": [0.1]}, "x", "y", "fold", [0, 1])
    assert seen[0] <= spark.sparkContext.defaultParallelism


def test_a_branch_adds_up_the_smaller_sides(monkeypatch):
    rng, rows, whole = np.random.default_rng(1), [], growing.histogram
    monkeypatch.setattr(growing, "histogram", lambda x, g, w: rows.append(len(x)) or whole(x, g, w))
    x = rng.integers(0, 32, (500, 6)).astype(np.uint8)
    y = x[:, 0] * 1.0 + rng.normal(size=500)
    growing.finish(growing.Plan(1, 2), x, y, np.ones(500), 2)
    assert sum(rows) <= 750
    assert (whole(x, y, np.ones(500))[1].sum(axis=1) == 500).all()
