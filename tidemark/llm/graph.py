"""Connected components by alternating stars (Kiveris et al., 2014), without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(id, component) of every node that has a link; component is its smallest node.

    edges: (a, b) longs in any direction; loops, repeated links and nulls are allowed and add nothing.  Each half
    round is an aggregation with partial sums and a join, so no node's links meet in one task; rounds are
    written, and end when all links point at a node that points nowhere.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = scratch.save(pairs, f"{label}0")
    k = 0
    while True:
        out = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        inner = pairs.select(F.col("b").alias("a")).distinct().join(pairs.select("a"), "a", "left_semi").limit(1)
        if not out.where("n > 1").limit(1).count() and not inner.count():
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b"),
        ).union(least.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        pairs = scratch.save(small, f"{label}{k}")
        scratch.drop(f"{label}{k - 1}")
