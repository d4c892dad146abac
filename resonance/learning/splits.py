"""Train/test split and fold assignment that depend on row keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonance.operators.quantiles import order_statistics

TEST_SHARE = 0.2


def key_share(key: str | Column) -> Column:
    """A number in [0, 1) that is fixed for a key: its hash as a fraction."""
    c = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def split(df: DataFrame, key: str, test_share: float = TEST_SHARE) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` by key hash: no shuffle, and stable as the table grows."""
    in_test = key_share(key) < test_share
    return df.where(~in_test), df.where(in_test)


def with_hash_fold(df: DataFrame, key: str, folds: int = 5, out: str = "fold") -> DataFrame:
    """Assign each row to one of ``folds`` by key hash."""
    return df.withColumn(out, F.floor(key_share(key) * folds).cast("int"))


def with_contiguous_fold(df: DataFrame, key: str, folds: int = 5, out: str = "fold") -> DataFrame:
    """Assign rows in key order to folds of equal size, the first ones larger by one.

    Only the keys at which a fold starts are looked up (exact order statistics);
    no row is moved. Keys are numeric and unique.
    """
    start = lambda i: i * F.floor(F.col("_n") / folds) + F.least(F.lit(i), F.col("_n") % folds)
    ranks = F.filter(
        F.array(*[start(i).cast("bigint") for i in range(1, folds)]), lambda x: x < F.col("_n")
    )
    bounds = (
        order_statistics(df, [], key, ranks, [i / folds for i in range(1, folds)])
        .agg(F.array_sort(F.collect_list("value")).alias("b"))
        .scalar()
    )
    reached = [F.coalesce((F.col(key) >= F.get("_b", i)).cast("int"), F.lit(0)) for i in range(folds - 1)]
    return df.withColumn("_b", bounds).withColumn(out, sum(reached)).drop("_b")
