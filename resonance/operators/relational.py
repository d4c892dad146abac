"""Joins, coverage, collection, projection, ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resonance.functions import scalars as S


def attach_text(posts: DataFrame, texts: DataFrame, key: str = "post_url") -> DataFrame:
    """Left join of posts to texts on the normalised URL; repeated texts fan out.

    A left join can only split a skewed *left* side. Written as inner join plus
    the posts without a text, either side of a hot URL can be split by AQE: the
    inner join splits both, the anti join sees each text key once. A null URL
    matches nothing.
    """
    left = posts.withColumn(key, S.url_key(F.col(key)))
    right = texts.withColumn(key, S.url_key(F.col(key)))
    matched = left.join(right, key, "inner")
    missing = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(missing, allowMissingColumns=True)


def text_coverage(joined: DataFrame, text: str = "post_text") -> DataFrame:
    """Posts in all, with text and without."""
    return joined.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.count(text).alias("with_text"),
        F.count_if(F.col(text).isNull()).alias("missing_text"),
    )


def url_coverage(posts: DataFrame, url: str = "post_url") -> DataFrame:
    """How many records have a URL and how many lack one."""
    status = F.when(F.col(url).isNotNull(), "FOUND").otherwise("MISSING")
    return posts.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("records"))


def seen_urls(done: DataFrame, url: str = "post_url") -> DataFrame:
    """The distinct URLs collected so far; only ever the right side of an anti join."""
    return done.select(url).distinct()


def engaged(df: DataFrame, text: str = "post_text", rate: str = "engagement_rate") -> DataFrame:
    """Posts with a text and some engagement."""
    return df.where(F.col(text).isNotNull() & (F.col(rate) > 0))


def new_texts(incoming: DataFrame, done: DataFrame, url: str = "post_url", text: str = "post_text",
              normalize: bool = False) -> DataFrame:
    """Incoming texts whose URL was not collected before; no URL or no text is left out.

    URLs compare raw (``normalize=True`` compares their join keys). A URL twice in
    one batch is kept twice.
    """
    key = S.url_key if normalize else (lambda c: c)
    seen = done.select(key(F.col(url)).alias("_seen")).distinct()
    usable = incoming.where(F.col(url).isNotNull() & S.not_blank(F.col(text)))
    return usable.join(seen, key(usable[url]) == seen["_seen"], "left_anti").withColumn(text, S.strip(F.col(text)))


def append_new_texts(incoming: DataFrame, done: DataFrame, **kwargs) -> DataFrame:
    """The collected table after this batch."""
    fresh = new_texts(incoming, done, **kwargs)
    return done.unionByName(fresh.select(*done.columns))


def preview(df: DataFrame, order_by: str | Column, n: int = 5) -> DataFrame:
    """First rows in a stated order (a table has none of its own)."""
    return df.orderBy(order_by).limit(n)


def fill_numeric(df: DataFrame, names: Sequence[str], value: float = 0) -> DataFrame:
    return df.fillna(value, subset=list(names))


def fill_text(df: DataFrame, name: str = "post_text") -> DataFrame:
    return df.fillna("", subset=[name])


def drop_missing(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names))


def ranked(df: DataFrame, by: str, *tiebreak: str, absolute: bool = False) -> DataFrame:
    """Sort by a metric, largest (or largest in size) first."""
    value = F.abs(F.col(by)) if absolute else F.col(by)
    return df.orderBy(value.desc(), *tiebreak)


def report_order(by: str, *tiebreak: str) -> WindowSpec:
    """Numbering order of a finished top-k report (never of a whole table)."""
    return W.orderBy(F.col(by).desc(), *tiebreak)


def extremes(df: DataFrame, by: str, k: int = 20, tiebreak: str = "keyword") -> DataFrame:
    """The k largest and the k smallest rows, marked ``top`` and ``bottom``."""
    top = df.orderBy(F.col(by).desc(), tiebreak).limit(k).withColumn("side", F.lit("top"))
    bottom = df.orderBy(F.col(by).asc(), tiebreak).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def influence_shades(df: DataFrame, group: str = "post_id", score: str = "score") -> DataFrame:
    """Contribution of each row to its group's mean, with colour and opacity.

    Mean and extremes are aggregated before the shuffle and joined back; a
    window would bring a whole group into one task.
    """
    stats = df.groupBy(group).agg(
        F.avg(score).alias("_mean"), F.min(score).alias("_min"), F.max(score).alias("_max")
    )
    contribution = F.col(score) - F.col("_mean")
    largest = F.greatest(F.col("_max") - F.col("_mean"), F.col("_mean") - F.col("_min"))
    scale = F.coalesce(F.nullif(largest, F.lit(0.0)), F.lit(1.0))
    return (
        df.join(stats, group)
        .withColumn("contribution", contribution)
        .withColumn("opacity", 0.25 + 0.75 * F.abs(F.col("contribution")) / scale)
        .withColumn("colour", F.when(F.col("contribution") > 0, "green").otherwise("red"))
        .drop("_mean", "_min", "_max")
    )
