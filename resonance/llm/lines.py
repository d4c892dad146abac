"""Boilerplate lines by their spread over sites, in DataFrame functions only.

A line's spread is the number of distinct sites that show it. Each line hash gets a HyperLogLog sketch, merged by
aggregation; lines of one site leave by their least and greatest site, and where the estimate is near the threshold,
distinct sites are counted exactly. A hot line or site is reduced where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonance.sources.scratch import written

#: Distinct sites from which a line counts as boilerplate.
MIN_SITES = 10
#: Estimates within this factor of the threshold are counted exactly; the sketch errs by some 2 %.
NEAR = 2.0
SKETCH_BITS = 12


def line_rows(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """Position and hash of every line that is not blank. Two 64-bit hashes together stand for a line."""
    rows = docs.select(
        F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(site).alias("site"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"),
    )
    line = F.trim("line")
    return rows.where(line != "").select(
        "k", "t", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")
    )


def boilerplate(rows: DataFrame, min_sites: int) -> DataFrame:
    """``h1, h2, first``: lines on ``min_sites`` sites or more, and the first place of each.

    Rows of a line are summed up in their task, as sketch, least and greatest site, before they move; where the estimate
    is near the threshold, (line, site) pairs are made distinct first and then counted. So a line that very many rows
    share costs a row for each task, or for each task and site.
    """
    spread = rows.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.min("site").alias("low"), F.max("site").alias("high"),
        F.min(F.struct("k", "pos", "t")).alias("first"),
    )
    several = spread.where("low < high") if min_sites > 1 else spread.where("low is not null")
    sketched = written(several.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("about")), "line-spread")
    sure = sketched.where(F.col("about") > min_sites * NEAR)
    near = sketched.where(F.col("about").between(min_sites / NEAR, min_sites * NEAR))
    sites = rows.where("site is not null").select("h1", "h2", "site").distinct()
    counted = sites.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("site").alias("n"))
    enough = counted.where(F.col("n") >= min_sites)
    return sure.select("h1", "h2", "first").union(
        near.join(enough, ["h1", "h2"]).select("h1", "h2", "first")
    )


def without(lines: Column, gone: Column) -> Column:
    """The array ``lines`` without the positions in the ascending array ``gone``."""
    before = F.concat(F.array(F.lit(-1)), gone)
    after = F.concat(gone, F.array(F.size(lines)))
    kept = F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.flatten(kept)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, key: str = "doc_id",
                       text: str = "text", site: str = "source") -> DataFrame:
    """All columns of ``docs`` in ``row``; ``cleaned``, the text without lines shown by ``min_sites`` sites or more.

    Lines are compared without spaces around them; blank lines stay. With ``keep_first`` the first place of a
    line (least key, then position) keeps it. ``n_lines`` and ``n_removed`` count the lines that were
    there and that went. A null text stays null, with 0 lines; a null site counts for no line; repeated rows are
    cleaned alike, rows of one key with different texts each by its own lines. An empty table gives an empty table.
    """
    rows = written(line_rows(docs, key, text, site), "lines")
    hits = rows.join(boilerplate(rows, min_sites), ["h1", "h2"])
    if keep_first:
        here = F.struct("k", "pos", "t")
        hits = hits.where(~here.eqNullSafe(F.col("first")))
    gone = hits.groupBy("k", "t").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    parts = docs.select(F.struct(*columns).alias("row"), F.xxhash64(text).alias("rt")).join(
        gone, F.col(f"row.`{key}`").eqNullSafe(F.col("k")) & (F.col("rt") == F.col("t")), "left"
    )
    whole = F.col(f"row.`{text}`")
    lines = F.split(whole, "\n", -1)
    cleaned = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(without(lines, F.col("gone")), "\n"))
    return parts.select(
        "row", cleaned.alias("cleaned"), F.when(whole.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
