"""Connected components by alternating star contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.sources.scratch import shared_folder

#: Each round at least halves the depth of a tree, so this is out of reach; beyond it is an error.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of every node in ``edges`` (columns ``a, b``).

    In a round every node hands its larger neighbours to its least one, then its smaller ones too; both steps
    keep connectivity. It ends when every edge leads to a least node. Nodes without edges are not returned;
    null ends and loops are dropped. Only two sums reach the driver in a round. A hot node's neighbours are
    reduced to a minimum before the shuffle and joined back with a join that Spark can split.
    """
    shared_folder(edges.sparkSession)  # checkpoints go there
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = ordered.distinct().checkpoint()
    seen = None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
        joined = large.join(low, F.col("a") == F.col("c"))
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.union(low.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct().checkpoint()
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not complete after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
