import pytest
from pyspark.sql import functions as F

from resonance.functions import scalars as S


def values(spark, column, data, schema="a string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in data]
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_parse_int(spark):
    given = ["1,234", " 12 ", "12.7", "-3.9", "1e3", "", "5%", "nan", "inf", "12d", "1_000", None, "0x10", "+7", "1__0"]
    want = [1234, 12, 12, -3, 1000, 0, 0, 0, 0, 0, 1000, 0, 0, 7, 0]
    assert values(spark, S.parse_int(F.col("a")), given) == want


def test_post_hour(spark):
    date = F.to_timestamp(F.lit("2024-05-06 17:30:00"))
    given = ["9:30 PM", "21:30", "2024-01-01 10:00", "abc", "", "  ", None, " 7 :15", "9 PM"]
    want = [9, 21, 10, None, 17, 17, 17, 7, 21]
    assert values(spark, S.post_hour(F.col("a"), date), given) == want


def test_post_hour_of_a_value_that_is_no_text(spark):
    date = F.to_timestamp(F.lit("2024-05-06 17:30:00"))
    assert values(spark, S.post_hour(F.col("a"), date, F.lit(False)), ["9:30"]) == [17]


def test_post_hour_with_am_pm(spark):
    date = F.lit(None).cast("timestamp")
    given = ["9:30 PM", "12:05 AM", "12:05 pm", "21:30"]
    assert values(spark, S.post_hour(F.col("a"), date, ampm=True), given) == [21, 0, 12, 21]


def test_is_post_url(spark):
    given = ["https://linkedin.com/x", "HTTP://WWW.LINKEDIN.COM", "https://de.linkedin.com/x", None, "see https://linkedin.com"]
    assert values(spark, S.is_post_url(F.col("a")), given) == [True, True, False, False, True]


def test_host_dots_are_literal(spark):
    assert values(spark, S.is_post_url(F.col("a"), "a.b"), ["http://a.b/x", "http://axb/x"]) == [True, False]


def test_url_key(spark):
    assert values(spark, S.url_key(F.col("a")), [" u/a// ", "u/a", None, "/"]) == ["u/a", "u/a", None, ""]


def test_engagement_rate(spark):
    rate = S.engagement_rate(F.col("i"), F.col("r"), F.col("c"), F.col("s"))
    data = [(0, 5, 0, 0), (10, 1, 2, 2), (-1, 5, 5, 5)]
    assert values(spark, rate, data, "i bigint, r bigint, c bigint, s bigint") == [0.0, 0.5, 0.0]


def test_known_or(spark):
    assert values(spark, S.known_or(F.col("a")), ["Poll", "Reel", None]) == ["Poll", "Text", "Text"]


@pytest.mark.parametrize(
    "text, want",
    [("a b", ["a", "b"]), ("  a\n\tb c ", ["a", "b", "c"]), ("", []), ("   ", [])],
)
def test_words(spark, text, want):
    assert values(spark, S.words(F.col("a")), [text]) == [want]


def test_first_date_takes_the_first_readable(spark):
    date = F.date_format(S.first_date(F.col("a"), F.col("b")), "yyyy-MM-dd HH:mm")
    data = [("soon", "2024-02-03"), ("3/4/2024", "2020-01-01"), ("Mar 5, 2024", None), (None, None),
            ("2024-01-02T03:04:05", "x")]
    want = ["2024-02-03 00:00", "2024-03-04 00:00", "2024-03-05 00:00", None, "2024-01-02 03:04"]
    assert values(spark, date, data, "a string, b string") == want


def test_present_key_counts_even_without_value(spark):
    entries = F.create_map(F.lit("impressions"), F.lit(None).cast("int"), F.lit("views"), F.lit(7))
    assert values(spark, S.first_present(entries, "impressions", "views"), ["x"]) == [None]
    assert values(spark, S.first_present(entries, "reach", "views"), ["x"]) == [7]


def test_common_date_spellings(spark):
    want = {
        "Dec 25, 2024 10:30 AM": "2024-12-25 10:30:00", "2024-12-25T10:30:00Z": "2024-12-25 10:30:00",
        "25.12.2024": "2024-12-25 00:00:00", "12/25/24": "2024-12-25 00:00:00", "25/12/2024": "2024-12-25 00:00:00",
        "2024-12-25 10:30:00.5": "2024-12-25 10:30:00", "25-Dec-2024": "2024-12-25 00:00:00", "12/25/2024 1:05 PM": "2024-12-25 13:05:00",
        "2024-12-25T10:30:00+02:00": "2024-12-25 08:30:00", "December 25, 2024": "2024-12-25 00:00:00", "25 December 2024": "2024-12-25 00:00:00",
        "no date": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "d string")
    got = {r["d"]: r["t"] for r in df.select("d", F.date_format(S.first_date(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert got == want


def test_boolean_cells_count(spark):
    df = spark.createDataFrame([("True", "boolean", 1), ("False", "boolean", 0), ("True", "string", 0), ("7", "number", 7), (None, None, 0)],
                               "v string, t string, n int")
    assert all(r["p"] == r["n"] for r in df.select("n", S.parse_int(F.col("v"), F.col("t")).alias("p")).collect())
