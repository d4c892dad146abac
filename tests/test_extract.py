import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from resonance.operators import extract

URL = "https://www.linkedin.com/posts/a"
SCHEMA = "file string, row int, col int, value string, ctype string"


def sheet(name, *rows, ctype="string"):
    return [(name, r, c, v, ctype) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]


def posts(spark, *sheets, parts=3, **kw):
    cells = spark.createDataFrame([cell for s in sheets for cell in s], SCHEMA).repartition(parts)
    return {r["file"]: r.asDict() for r in extract.consolidate(cells, **kw).collect()}


def one(spark, *rows, **kw):
    return posts(spark, sheet("f", *rows), **kw)["f"]


def test_url_lost_to_the_header_reading_is_found_by_position(spark):
    got = one(spark, ["Post URL", URL], ["Impressions", "100"])
    assert (got["post_url"], got["impressions"]) == (URL, 100)


def test_first_metric_of_a_vertical_sheet_is_misread(spark):
    rows = (["Impressions", "100"], ["Reactions", "5"])
    got = one(spark, *rows)
    assert (got["impressions"], got["reactions"]) == (0, 5)
    repaired = one(spark, *rows, repair_row0=True)
    assert (repaired["impressions"], repaired["reactions"]) == (100, 5)


def test_horizontal_sheet(spark):
    got = one(
        spark,
        ["Post URL", "Post Date", "Post Publish Time", "Impressions", "Reactions", "Comments", "Reposts", "Saves"],
        [" " + URL, "2024-05-07", "9:15", "1,000", "10", "5", "5", "7"],
    )
    assert got["post_url"] == " " + URL  # not trimmed on this path
    assert (got["weekday"], got["month"], got["year"], got["hour"]) == (1, 5, 2024, 9)
    assert (got["impressions"], got["saves"], got["engagement_rate"]) == (1000, 7, 0.02)


def test_horizontal_sheet_with_url_ignores_labels_down_the_side(spark):
    got = one(spark, ["Post URL", "Impressions"], [URL, "10"], ["Reactions", "9"])
    assert got["reactions"] == 0


def test_value_below_header_is_the_first_filled_one(spark):
    got = one(spark, ["Post URL", "Impressions"], [URL, None], [None, "12"])
    assert got["impressions"] == 12


def test_same_header_twice_takes_the_first_column_variants_the_last(spark):
    same = one(spark, ["Post URL", "Impressions", "Impressions"], [URL, "1", "2"])
    variant = one(spark, ["Post URL", "Impressions", " IMPRESSIONS"], [URL, "1", "2"])
    assert (same["impressions"], variant["impressions"]) == (1, 2)


def test_free_standing_url(spark):
    assert one(spark, ["note", "x"], [None, None, f" {URL} "])["post_url"] == URL


@pytest.mark.parametrize(
    "rows, want",
    [
        ((["x"], ["Link url", None], [URL + "b", None]), "b"),
        ((["x"], ["Link url", None], [None, URL + "d"]), "d"),
        ((["x"], ["Link url", URL + "r"], [URL + "b", URL + "d"]), "r"),
        ((["x", URL + "far"], ["Link url", None], [None, URL + "d"]), "d"),
    ],
)
def test_neighbouring_url(spark, rows, want):
    assert one(spark, *rows)["post_url"] == URL + want


def test_url_label_must_be_text(spark):
    cells = sheet("f", ["x"], [None, URL + "first"]) + [("f", 3, 0, "the url", "datetime"), ("f", 3, 1, URL + "next", "string")]
    assert posts(spark, cells)["f"]["post_url"] == URL + "first"


def test_first_of_repeated_labels_down_the_side(spark):
    assert one(spark, ["x", "y"], ["Reactions", "5"], ["Reactions", "9"])["reactions"] == 5


def test_label_without_value_hides_the_other_name(spark):
    assert one(spark, ["x", "y"], ["Impressions", None], ["Views", "7"])["impressions"] == 0
    assert one(spark, ["x", "y"], ["Views", "7"])["impressions"] == 7


def test_empty_url_entry_gives_way_to_its_alias(spark):
    assert one(spark, ["x", "y"], ["Post URL", ""], ["PostURL", "other"])["post_url"] == "other"


def test_time_that_is_no_text_takes_the_hour_of_the_date(spark):
    cells = sheet("f", ["x", "y"], ["Post Date", "2024-05-07 18:00:00"]) + [
        ("f", 2, 0, "Time", "string"), ("f", 2, 1, "1899-12-30 09:00:00", "datetime")]
    assert posts(spark, cells)["f"]["hour"] == 18


def test_sheet_without_any_known_label_still_gives_a_record(spark):
    got = one(spark, ["a", "b"], ["c", "d"])
    assert got["post_url"] is None and got["post_date"] is None and got["hour"] is None
    assert (got["impressions"], got["engagement_rate"]) == (0, 0.0)


counts = st.integers(min_value=0, max_value=10_000)
record = st.tuples(counts, counts, counts, counts, counts, st.booleans(), st.integers(0, 23))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(record, min_size=1, max_size=12), st.integers(1, 5))
def test_records_survive_the_way_through_sheets(spark, records, parts):
    labels = ["Post URL", "Post Date", "Post Publish Time", "Impressions", "REACTIONS", " comments", "Reposts", "Saves"]
    sheets, want = [], {}
    for i, (imp, rea, com, rep, sav, across, hour) in enumerate(records):
        cells = [f"{URL}{i}", "2024-05-07", f"{hour}:05", f"{imp:,}", str(rea), str(com), str(rep), str(sav)]
        rows = [labels, cells] if across else list(zip(labels, cells))
        sheets.append(sheet(str(i), *rows))
        want[str(i)] = (f"{URL}{i}", hour, imp, rea, com, rep, sav, (rea + com + rep) / imp if imp else 0.0)
    got = posts(spark, *sheets, parts=parts)
    fields = ("post_url", "hour", "impressions", "reactions", "comments", "reposts", "saves", "engagement_rate")
    assert {k: tuple(v[f] for f in fields) for k, v in got.items()} == want
