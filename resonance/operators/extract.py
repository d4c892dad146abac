"""Sheet cells to one record per file, as relational steps over all files at once.

A cell table has ``file, row, col, value, ctype``. Four ways of finding a
record's entries are computed side by side, each reduced to a handful of rows
per file, and combined in one aggregation by file:

A  labels across the first row, values below them
B  labels down the first column, values beside them
C  a URL beside, below or diagonally below a cell that names a URL
D  any URL on the sheet

Every aggregation here has a partial form, so a file with a great many cells is
reduced where it is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonance.functions import scalars as S

# Labels that mark a header row, labels of a URL cell, labels read.
HEADER_LABELS = ("post url", "post date", "impressions", "reactions", "comments")
URL_LABELS = ("post url", "posturl", "post link", "url")
URL_KEYS = ("post url", "posturl", "post link")
DATE_KEYS = ("post date", "date", "published", "post_date")
TIME_KEYS = ("post publish time", "publish time", "time")
METRIC_KEYS = ("impressions", "views", "reactions", "comments", "reposts", "saves")
KNOWN_KEYS = URL_KEYS + DATE_KEYS + TIME_KEYS + METRIC_KEYS


def _contains_any(c: Column, labels: tuple[str, ...]) -> Column:
    text = F.lower(c)
    return reduce(lambda a, b: a | b, [text.contains(label) for label in labels])


def _is_header_row() -> Column:
    """Aggregate over a file's cells: does one of the first row name a known column?"""
    named = (F.col("row") == 0) & _contains_any(F.col("value"), HEADER_LABELS)
    return F.bool_or(F.coalesce(named, F.lit(False)))


def _first_url(host: str) -> Column:
    """Aggregate over a file's cells: the first URL cell, row by row."""
    place = F.when(S.is_post_url(F.col("value"), host), F.struct("row", "col"))
    return S.strip(F.min_by("value", place))


def header_like(cells: DataFrame) -> DataFrame:
    """Per file: does a cell of the first row name a known column?"""
    return cells.where(F.col("row") == 0).groupBy("file").agg(_is_header_row().alias("header_like"))


def header_entries(cells: DataFrame) -> DataFrame:
    """A: ``file, key, value, ctype`` from first-row labels and the first value below each.

    Of columns with the very same label the first counts; of labels that differ
    in case or blanks only, the last one does.
    """
    entry = F.struct("value", "ctype")
    below = (F.col("row") > 0) & F.col("value").isNotNull()
    columns = (
        cells.groupBy("file", "col")
        .agg(
            F.max(F.when(F.col("row") == 0, F.col("value"))).alias("label"),
            F.min_by(F.when(below, entry), F.when(below, F.col("row"))).alias("entry"),
        )
        .withColumn("key", S.normalize_key(F.col("label")))
        .where(F.col("key").isin(*KNOWN_KEYS))
    )
    one_per_label = columns.groupBy("file", "key", "label").agg(
        F.min("col").alias("col"), F.min_by(F.struct("entry"), "col").alias("e")
    )
    return (
        one_per_label.groupBy("file", "key")
        .agg(F.max_by("e", "col").alias("e"))
        .select("file", "key", "e.entry.value", "e.entry.ctype")
    )


def column_entries(cells: DataFrame) -> DataFrame:
    """B: ``file, key, value, ctype`` from labels in column 0 and values in column 1."""
    left, right = F.col("col") == 0, F.col("col") == 1
    rows = (
        cells.where(F.col("col").isin(0, 1))
        .groupBy("file", "row")
        .agg(
            F.max(F.when(left, F.col("value"))).alias("label"),
            F.max(F.when(right, F.col("value"))).alias("value"),
            F.max(F.when(right, F.col("ctype"))).alias("ctype"),
        )
        .withColumn("key", S.normalize_key(F.col("label")))
        .where(F.col("key").isin(*KNOWN_KEYS))
    )
    return (
        rows.groupBy("file", "key")
        .agg(F.min_by(F.struct("value", "ctype"), "row").alias("e"))
        .select("file", "key", "e.value", "e.ctype")
    )


def neighbour_urls(cells: DataFrame, host: str = S.POST_HOST) -> DataFrame:
    """C: per file the URL next to the first cell (row by row) that names a URL.

    The value to the right wins over the one below, that over the diagonal. Only
    cells with a URL or such a label take part in the join.
    """
    is_url = S.is_post_url(F.col("value"), host)
    is_label = F.coalesce(
        (F.col("ctype") == "string") & _contains_any(F.col("value"), URL_LABELS), F.lit(False)
    )
    # A cell stands at its own place as a label, and at the three places it can be
    # seen from as a URL.
    offsets = ((0, 1), (1, 0), (1, 1))
    places = F.array(
        F.struct(F.col("row").alias("row"), F.col("col").alias("col"), F.lit(-1).alias("rank"), is_label.alias("use")),
        *[
            F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.lit(i).alias("rank"),
                     is_url.alias("use"))
            for i, (dr, dc) in enumerate(offsets)
        ],
    )
    is_candidate = F.col("rank") >= 0
    return (
        cells.where(is_url | is_label)
        .select("file", "value", F.explode(places).alias("p"))
        .select("file", "value", "p.*")
        .where("use")
        .groupBy("file", "row", "col")
        .agg(
            F.bool_or(~is_candidate).alias("labelled"),
            F.min_by("value", F.when(is_candidate, F.col("rank"))).alias("url"),
            F.bool_or(is_candidate).alias("has_url"),
        )
        .where("labelled AND has_url")
        .groupBy("file")
        .agg(S.strip(F.min_by("url", F.struct("row", "col"))).alias("url"))
    )


def any_url(cells: DataFrame, host: str = S.POST_HOST) -> DataFrame:
    """D: per file the first URL cell, row by row."""
    return cells.where(S.is_post_url(F.col("value"), host)).groupBy("file").agg(_first_url(host).alias("url"))


def _as_map(entries: DataFrame, name: str) -> DataFrame:
    """One map per file; it holds at most the known keys, each once."""
    pair = F.struct("key", F.struct("value", "ctype").alias("entry"))
    return entries.groupBy("file").agg(F.map_from_entries(F.collect_list(pair)).alias(name))


def extract_metrics(cells: DataFrame, host: str = S.POST_HOST, repair_row0: bool = False) -> DataFrame:
    """One row per file: ``file, url_by_position, entries``.

    ``entries`` maps each known label the sheet has to ``struct(value, ctype)``;
    a label without a value maps to nulls. A sheet whose header row yields a post
    URL is read across only; otherwise labels down the side fill the gaps and a
    URL found by C, else by D, replaces the ``post url`` entry.

    A vertical sheet whose first label is known reads as a header row too, which
    gives that label the *next* label as its value. ``repair_row0=True`` prefers
    the value beside the label in that case.
    """
    per_file = cells.groupBy("file").agg(_is_header_row().alias("across"), _first_url(host).alias("d"))
    found = (
        per_file.join(_as_map(header_entries(cells), "a"), "file", "left")
        .join(_as_map(column_entries(cells), "b"), "file", "left")
        .join(neighbour_urls(cells, host).withColumnRenamed("url", "c"), "file", "left")
    )
    empty = F.expr(
        "map_from_entries(cast(array() AS array<struct<key:string,entry:struct<value:string,ctype:string>>>))"
    )
    found = found.select(
        "file",
        F.coalesce(F.when(F.col("across"), F.col("a")), empty).alias("a"),
        F.coalesce("b", empty).alias("b"),
        F.coalesce("c", "d").alias("url"),
    ).withColumn("early", S.is_post_url(F.try_element_at("a", F.lit("post url"))["value"], host))
    if repair_row0:
        misread = lambda k, v: (
            S.normalize_key(v["value"]).isin(*KNOWN_KEYS) & F.map_contains_key("b", k) & ~F.col("early")
        )
        found = found.withColumn("a", F.map_filter("a", lambda k, v: ~misread(k, v)))
    by_position = F.when(~F.col("early"), F.col("url"))
    gaps = F.map_filter("b", lambda k, v: ~F.col("early") & ~F.map_contains_key(F.col("a"), k))
    fixed = F.create_map(F.lit("post url"), F.struct(F.col("url").alias("value"), F.lit("string").alias("ctype")))
    merged = found.select("file", by_position.alias("url"), F.map_concat("a", gaps).alias("entries"))
    return merged.select(
        "file",
        F.col("url").isNotNull().alias("url_by_position"),
        F.when(
            F.col("url").isNotNull(),
            F.map_concat(F.map_filter("entries", lambda k, v: k != "post url"), fixed),
        ).otherwise(F.col("entries")).alias("entries"),
    )


def to_posts(metrics: DataFrame, ampm: bool = False) -> DataFrame:
    """Typed post rows from extracted entries: ``file`` and the twelve post columns."""
    e = F.col("entries")

    def value(key: str) -> Column:
        return F.try_element_at(e, F.lit(key))["value"]

    def kind(key: str) -> Column:
        return F.try_element_at(e, F.lit(key))["ctype"]

    counted = F.map_contains_key(e, "impressions")
    views = F.when(counted, value("impressions")).otherwise(value("views"))
    views_kind = F.when(counted, kind("impressions")).otherwise(kind("views"))
    # The first time label that has a value decides, whatever its type.
    timed = F.coalesce(*[F.when(F.nullif(value(k), F.lit("")).isNotNull(), F.try_element_at(e, F.lit(k)))
                         for k in TIME_KEYS])
    dated = metrics.select(
        "file",
        S.first_truthy(*[value(k) for k in URL_KEYS]).alias("post_url"),
        S.first_date(*[value(k) for k in DATE_KEYS]).alias("post_date"),
        timed.alias("_time"),
        S.parse_int(views, views_kind).alias("impressions"),
        *[S.parse_int(value(m), kind(m)).alias(m) for m in ("reactions", "comments", "reposts", "saves")],
    )
    date = F.col("post_date")
    return dated.select(
        "file",
        "post_url",
        "post_date",
        *[c.alias(n) for n, c in S.date_parts(date).items()],
        S.post_hour(F.col("_time.value"), date, F.col("_time.ctype") == "string", ampm).alias("hour"),
        "impressions",
        "reactions",
        "comments",
        "reposts",
        "saves",
        S.engagement_rate(
            F.col("impressions"), F.col("reactions"), F.col("comments"), F.col("reposts")
        ).alias("engagement_rate"),
    )


def consolidate(cells: DataFrame, host: str = S.POST_HOST, **options) -> DataFrame:
    """All sheets of a cell table as one table of posts."""
    ampm = options.pop("ampm", False)
    return to_posts(extract_metrics(cells, host, **options), ampm)
