"""What the optimizer makes of the queries: no Python, no cross join, filters at the scan."""

import pytest

from resonance.catalog import registered_queries

BATCH_ONLY_SQL = ("f", "x", "r", "a1", "a2", "a3", "a4", "a5", "a6", "e1", "e2", "e4", "e5", "e6", "m1_", "m9", "m10", "m11")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registered_queries() if n.startswith(BATCH_ONLY_SQL)])
def test_plan_stays_in_the_jvm_and_never_crosses_tables(spark, sf, name):
    text = plan(registered_queries()[name](spark, sf))
    for forbidden in ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert forbidden not in text, forbidden


def test_scan_reads_only_the_columns_and_rows_needed(spark, sf):
    text = plan(registered_queries()["x5_any_url"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in text
    events = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id = 3")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in plan(events)


def test_exploratory_report(spark, sf):
    from resonance.plans import reports, standins

    posts = standins.posts(spark, sf).cache()
    report = reports.exploratory_report(posts)
    counts = {name: table.count() for name, table in report.items()}
    n = posts.count()
    assert counts["shape"] == 1 and counts["summary"] == 10 and counts["impressions_reactions"] == n
    assert {counts[f"{c}_{kind}"] for c in ("impressions", "engagement_rate") for kind in ("histogram",)} == {30}
    assert counts["impressions_density"] == 200 and counts["engagement_by_weekday"] == 7
    assert report["impressions_histogram"].agg({"n": "sum"}).first()[0] == n


def test_temporary_tables_are_removed(spark, tmp_path):
    import os

    from resonance.sources import scratch

    kept = scratch.written(spark.range(3), "kept")
    with scratch.temporary(spark):
        inner = scratch.written(spark.range(5), "inner")
        with scratch.temporary(spark):
            scratch.written(spark.range(7), "innermost")
        inner.write.parquet(str(tmp_path / "out"))
        folder = scratch.shared_folder(spark).removeprefix("file:")
        assert any(f.startswith("inner-") for f in os.listdir(folder))
        assert not any(f.startswith("innermost-") for f in os.listdir(folder))
    assert not any(f.startswith("inner-") for f in os.listdir(folder))
    assert kept.count() == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 5
