"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptloom.llm.common import materialise, shuffled


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) between different longs to (node, root): the smallest node that each linked node reaches.

    Every step is two aggregates and a join on the node, written to the shared folder. The number of steps grows with the logarithm
    of the number of nodes. Empty links give an empty result.
    """
    edges = materialise(edges.select("a", "b").distinct(), "links")
    before = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(shuffled(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(low), "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = materialise(small.distinct(), "small-star")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
