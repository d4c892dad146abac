"""The numbers behind each exploratory chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resonance.operators.quantiles import exact_percentiles, maybe_broadcast

QUARTILES = (0.25, 0.5, 0.75)
CORRELATED = ("impressions", "reactions", "comments", "reposts", "saves", "engagement_rate")


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value)`` rows of the given columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    long = _long(df, cols)
    basics = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = (
        exact_percentiles(long, ["column"], "value", QUARTILES, groups=len(cols))
        .groupBy("column")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"p{int(p * 100)}") for p in QUARTILES])
    )
    return basics.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def describe_numeric_approx(df: DataFrame, cols: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """As :func:`describe_numeric` with sketched quartiles: a single pass."""
    return (
        _long(df, cols)
        .groupBy("column")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.percentile_approx("value", list(QUARTILES), accuracy).alias("q"),
            F.max("value").alias("max"),
        )
        .select(
            "column", "count", "mean", "std", "min",
            *[F.col("q")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(QUARTILES)],
            "max",
        )
    )


def _range(df: DataFrame, c: str) -> Column:
    """``struct(lo, hi)`` of a column as a scalar subquery; a constant is widened by 0.5."""
    bounds = df.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
    pad = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    return bounds.select(F.struct((F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi")).alias("r")).scalar()


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Index of the equal-width bin; the last one is closed on the right."""
    return F.least(F.floor((value - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram with empty bins: ``bin, left_edge, right_edge, n``."""
    spark = df.sparkSession
    values = df.select(F.col(c).cast("double").alias("v")).where(F.col("v").isNotNull())
    span = _range(values, "v")
    binned = (
        values.withColumn("r", span)
        .groupBy(_bin(F.col("v"), F.col("r.lo"), F.col("r.hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    axis = spark.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("r", span)
    width = (F.col("r.hi") - F.col("r.lo")) / bins
    return axis.join(binned, "bin", "left").select(
        "bin",
        (F.col("r.lo") + F.col("bin") * width).alias("left_edge"),
        (F.col("r.lo") + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


#: Kernel widths beyond which a value adds less to the density than rounding does; parts of a width merged into one value.
SUPPORT, MERGED = 9.0, 4096


def kde(df: DataFrame, c: str, gridsize: int = 200, bins: int = 30) -> DataFrame:
    """Gaussian density on a grid, on the count scale of a histogram of ``bins``.

    Values within a ``MERGED``-th of the kernel's width count as their mean, which changes the density by less than one
    part in 10^8 (equal values are merged without loss); a merged value meets only the grid points within ``SUPPORT``
    widths. So work after the first aggregation depends on the range in widths, not on how many distinct values there
    are; partial sums per grid point are formed before the shuffle. A constant column, or one value, has no density: no
    rows.
    """
    spark = df.sparkSession
    values = df.select(F.col(c).cast("double").alias("v")).where(F.col("v").isNotNull())
    stats = (
        values.agg(
            F.count("v").alias("n"),
            F.stddev_samp("v").alias("sd"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
        )
        .select(F.struct("n", "sd", "lo", "hi").alias("s"))
        .scalar()
    )

    def with_scale(rows: DataFrame) -> DataFrame:
        step = (F.col("s.hi") - F.col("s.lo")) / (gridsize - 1)
        width = F.col("s.sd") * F.pow(F.col("s.n").cast("double"), F.lit(-0.2))
        return rows.withColumn("s", stats).where(F.col("s.sd") > 0).withColumns({"h": width, "step": step})

    merged = (
        with_scale(values)
        .groupBy(F.floor((F.col("v") - F.col("s.lo")) / F.col("h") * MERGED).alias("part"))
        .agg(F.count(F.lit(1)).alias("w"), F.avg("v").alias("v"))
    )
    place, reach = (F.col("v") - F.col("s.lo")) / F.col("step"), SUPPORT * F.col("h") / F.col("step")
    first = F.greatest(F.ceil(place - reach), F.lit(0)).cast("int")
    last = F.least(F.floor(place + reach), F.lit(gridsize - 1)).cast("int")
    bin_width = (F.col("s.hi") - F.col("s.lo")) / bins
    x = F.col("s.lo") + F.col("g") * F.col("step")
    kernel = F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("h"), 2.0)) / (F.col("h") * F.sqrt(2 * F.pi()))
    sums = (
        with_scale(merged)
        .where(first <= last)
        .withColumn("g", F.explode(F.sequence(first, last)))
        .groupBy("g")
        .agg(F.sum(F.col("w") * kernel * bin_width).alias("density"))
    )
    axis = with_scale(spark.range(gridsize).select(F.col("id").cast("int").alias("g"))).select("g", x.alias("x"))
    return axis.join(sums, "g", "left").select(
        F.col("g").alias("grid"), "x", F.coalesce("density", F.lit(0.0)).alias("density")
    )


def correlation_long(df: DataFrame, cols: Sequence[str] = CORRELATED) -> DataFrame:
    """Pearson correlation of every pair, one pass: ``a, b, r``."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                    for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"r{i}").alias("r")))
    return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.a", "p.b", "p.r")


def scatter_density(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """Counts on a grid of equal-width cells; only occupied cells are listed."""
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return (
        points.withColumn("rx", _range(points, "x"))
        .withColumn("ry", _range(points, "y"))
        .groupBy(
            _bin(F.col("x"), F.col("rx.lo"), F.col("rx.hi"), bins).alias("x_bin"),
            _bin(F.col("y"), F.col("ry.lo"), F.col("ry.hi"), bins).alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct points with their multiplicity: a scatter plot without overplotting."""
    return df.select(x, y).dropna().groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, by: str, c: str, groups: int | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme data within 1.5 IQR) and outlier count per group."""
    rows = df.select(F.col(by), F.col(c).cast("double").alias("v")).dropna()
    quartiles = (
        exact_percentiles(rows, [by], "v", QUARTILES, groups=groups)
        .groupBy(by)
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
               for p, n in zip(QUARTILES, ("q1", "median", "q3"))])
        .withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
        .withColumn("_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    )
    inside = (F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi"))
    return (
        rows.join(maybe_broadcast(quartiles, groups), by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def shape(df: DataFrame) -> DataFrame:
    """Row and column count of a stage."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def prediction_pairs(pred: DataFrame, *keep: str, label: str = "engagement_rate",
                     prediction: str = "prediction") -> DataFrame:
    """Actual against predicted values."""
    return pred.select(*keep, F.col(label).alias("actual"), F.col(prediction).alias("predicted"))


def identity_line(pred: DataFrame, label: str = "engagement_rate") -> DataFrame:
    """End points of the diagonal in an actual-against-predicted chart."""
    return pred.agg(F.min(label).alias("low"), F.max(label).alias("high"))
