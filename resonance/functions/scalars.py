"""Scalar clean-up rules for post metrics, dates, URLs and words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The post host, the date formats read, the post types known.
POST_HOST = "linkedin.com"
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S][XXX]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/M/d",
    "M/d/yyyy H:mm",
    "M/d/yyyy h:mm a",
    "M/d/yyyy",
    "M/d/yy",
    "d/M/yyyy",
    "M.d.yyyy",
    "d.M.yyyy",
    "MMM d, yyyy",
    "MMM d, yyyy H:mm",
    "MMM d, yyyy h:mm a",
    "MMMM d, yyyy",
    "MMMM d, yyyy h:mm a",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
)
TIME_FORMATS = ("h a", "ha")
POST_TYPES = ("Text", "Image", "Video", "Poll", "Link", "Article", "Document")

BLANKS = " \t\n\r\x0b\x0c "
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.btrim(c, F.lit(BLANKS))


def parse_int(c: Column, ctype: Column | None = None) -> Column:
    """Whole number in a messy cell; anything unreadable or null is 0.

    With ``ctype``, the kind of the cell, a boolean cell counts as 1 or 0.
    """
    if ctype is not None:
        truth = (ctype == "boolean") & (F.lower(c.cast("string")) == "true")
        c = F.when(truth, F.lit("1")).otherwise(c.cast("string"))
    text = strip(F.replace(c.cast("string"), F.lit(","), F.lit("")))
    text = F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")
    text = F.when(text.rlike(NUMBER), text)
    whole = text.try_cast("bigint")
    truncated = text.try_cast("double").try_cast("bigint")
    return F.coalesce(whole, truncated, F.lit(0).cast("bigint"))


def is_post_url(c: Column, host: str = POST_HOST) -> Column:
    """True if the value contains a link to ``host`` (bare or ``www.``)."""
    literal = "".join("\\" + ch if not ch.isalnum() else ch for ch in host)
    return F.coalesce(c.cast("string").rlike(rf"(?i)https?://(?:www\.)?{literal}"), F.lit(False))


def normalize_key(c: Column) -> Column:
    """Label of a sheet cell: trimmed, lower case, null as empty."""
    return F.coalesce(F.lower(strip(c.cast("string"))), F.lit(""))


def url_key(c: Column) -> Column:
    """Join key of a URL: trimmed, without trailing slashes."""
    return F.rtrim(strip(c.cast("string")), F.lit("/"))


def first_date(*cols: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First value among ``cols`` that one of the declared formats can read."""

    def read(c: Column) -> Column:
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt in formats])

    candidates = [strip(c.cast("string")) for c in cols]
    if len(candidates) == 1:
        return read(candidates[0])
    return F.get(F.array_compact(F.transform(F.array(*candidates), read)), 0)


def date_parts(date: Column) -> dict[str, Column]:
    """Weekday (Monday is 0), month and year of a date; null stays null."""
    return {"weekday": F.weekday(date), "month": F.month(date), "year": F.year(date)}


def post_hour(
    time: Column,
    date: Column,
    is_text: Column | None = None,
    ampm: bool = False,
) -> Column:
    """Hour of publication.

    A text time gives the number before its first colon, or else the hour of the
    timestamp it spells. A blank or non-text time gives the hour of ``date``.
    ``ampm=True`` also honours an AM/PM suffix.
    """
    text = strip(time.cast("string"))
    has_text = F.coalesce(text != "", F.lit(False))
    if is_text is not None:
        has_text = has_text & F.coalesce(is_text, F.lit(False))
    head = strip(F.split_part(text, F.lit(":"), F.lit(1)))
    leading = F.when(head.rlike(r"^[+-]?\d+$"), head).try_cast("int")
    if ampm:
        base = leading % 12
        leading = (
            F.when(text.rlike(r"(?i)p\.?m\.?$"), base + 12)
            .when(text.rlike(r"(?i)a\.?m\.?$"), base)
            .otherwise(leading)
        )
    spelled = F.hour(first_date(time, formats=(*DATE_FORMATS, *TIME_FORMATS)))
    return F.when(has_text, F.coalesce(leading, spelled)).otherwise(F.hour(date))


def engagement_rate(impressions: Column, reactions: Column, comments: Column, reposts: Column) -> Column:
    """Interactions per impression; 0 without impressions. Saves do not count."""
    interactions = (reactions + comments + reposts).cast("double")
    return F.when(impressions > 0, interactions / impressions).otherwise(F.lit(0.0))


def known_or(c: Column, allowed: Sequence[str] = POST_TYPES, default: str = "Text") -> Column:
    """The value if it is an allowed one, else ``default`` (also for null)."""
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def first_truthy(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_present(values: Column, *keys: str) -> Column:
    """Value of the first key the map contains, even if that value is null."""
    chosen = F.lit(None)
    for key in reversed(keys):
        chosen = F.when(F.map_contains_key(values, key), F.try_element_at(values, F.lit(key))).otherwise(chosen)
    return chosen


def words(text: Column) -> Column:
    """Words of a text, cut at any run of white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def not_blank(text: Column) -> Column:
    """Guard before scoring: the text has something to score."""
    return F.coalesce(strip(text) != "", F.lit(False))
