"""Connected components by alternating large and small stars, in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, label for every node of an edge (a, b): label is the smallest node reachable. Number of rounds: logarithmic.

    Each round takes minima (combined before the shuffle) and joins them back, so a node with many
    edges is a skewed join side that adaptive execution splits, never a gathered list.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    e = scratch.save(edges.filter("a != b").select(big.alias("u"), small.alias("v")).distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large)
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        joined = large.join(least, F.col("u") == F.col("x"))
        small_star = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        new = scratch.save(small_star)
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(e, large)
        e = new
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
