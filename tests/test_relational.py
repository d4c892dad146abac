import pytest
from pyspark.sql import functions as F

from resonance.operators import relational
from resonance.sources import tables


def posts(spark, *urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, post_url string")


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "post_url string, post_text string")


def test_text_found_whatever_the_slashes(spark):
    out = relational.attach_text(posts(spark, " u/a// ", "u/b"), texts(spark, ("u/a", "x"))).orderBy("id").collect()
    assert [(r["post_url"], r["post_text"]) for r in out] == [("u/a", "x"), ("u/b", None)]


def test_repeated_texts_fan_out_and_nulls_match_nothing(spark):
    out = relational.attach_text(posts(spark, "a", None), texts(spark, ("a", "1"), ("a/", "2"), (None, "3")))
    assert sorted((r["id"], r["post_text"] or "") for r in out.collect()) == [(0, "1"), (0, "2"), (1, "")]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_hot_url_equals_the_plain_left_join(spark, threshold):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        left = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("post_url"))
        right = spark.range(300).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("post_url"),
            F.col("id").cast("string").alias("post_text"))
        got = relational.attach_text(left, right).select("id", "post_text").collect()
        want = left.join(right, "post_url", "left").select("id", "post_text").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_new_texts(spark):
    incoming = texts(spark, ("a", "old"), ("b", " new \n"), ("b", "again"), (None, "x"), ("c", " \t"), ("d/", "y"))
    done = texts(spark, ("a", "old"), ("d", "y"))
    raw = {(r[0], r[1]) for r in relational.new_texts(incoming, done).collect()}
    assert raw == {("b", "new"), ("b", "again"), ("d/", "y")}
    same = {(r[0], r[1]) for r in relational.new_texts(incoming, done, normalize=True).collect()}
    assert same == {("b", "new"), ("b", "again")}
    assert relational.append_new_texts(incoming, done).count() == 5


def test_influence_shades(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, -1.0), (1, 2, -1.0), (2, 0, 5.0)], "post_id int, pos int, score double")
    rows = {(r["post_id"], r["pos"]): r for r in relational.influence_shades(df).collect()}
    assert [(rows[1, p]["colour"], rows[1, p]["opacity"]) for p in range(3)] == [("green", 1.0), ("red", 0.625), ("red", 0.625)]
    assert (rows[2, 0]["contribution"], rows[2, 0]["opacity"], rows[2, 0]["colour"]) == (0.0, 0.25, "red")


def test_guards(spark):
    df = posts(spark, "a")
    with pytest.raises(ValueError, match="post_text"):
        tables.require_columns(df, "post_url", "post_text")
    with pytest.raises(ValueError, match="no text column"):
        tables.text_column(df)
    assert tables.text_column(df.withColumn("text", F.lit("x"))) == "text"
    assert tables.existing(df, ["likes", "id"]) == ["id"]


def test_csv_keeps_line_ends_quotes_and_blanks(spark, tmp_path):
    rows = [("u", 'a "b"\nc, d\r\n e '), ("v", None), ("w", ""), ("x", "back\\slash")]
    path = str(tmp_path / "t")
    tables.write_table(texts(spark, *rows), path)
    tables.write_table(texts(spark, *rows), path)  # replaces
    want = [(u, t or None) for u, t in rows]  # in CSV an empty text is a missing one
    assert sorted(tuple(r) for r in tables.read_texts(spark, path).collect()) == sorted(want)
