"""The exploratory report: every chart's numbers for one table of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from resonance.operators import describe
from resonance.sources.tables import POST_SCHEMA

SUMMARISED = tuple(f.name for f in POST_SCHEMA if isinstance(f.dataType, T.NumericType))


def exploratory_report(posts: DataFrame) -> dict[str, DataFrame]:
    """Lazy tables by name; persist ``posts`` first if it is expensive to build."""
    report = {
        "shape": describe.shape(posts),
        "summary": describe.describe_numeric(posts, SUMMARISED),
        "correlations": describe.correlation_long(posts),
        "impressions_reactions": posts.select("impressions", "reactions").dropna(),
    }
    for c in ("impressions", "engagement_rate"):
        report[f"{c}_histogram"] = describe.histogram(posts, c)
        report[f"{c}_density"] = describe.kde(posts, c)
    if "weekday" in posts.columns:
        report["engagement_by_weekday"] = describe.box_stats(posts, "weekday", "engagement_rate", groups=7)
    return report
