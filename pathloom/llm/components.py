"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.lineage import checkpointed, sweep


def _star_step(now: DataFrame) -> DataFrame:
    """One large-star and small-star step over now(a, b), a > b. All sides grow with the input, so none is sent to the driver to be broadcast, however few bytes its shuffle has."""
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(low.hint("merge"), "a")
    small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root): every node of an edge, with the smallest node of its component.

    Self-loops are ignored. Each step keeps at most as many edges as it got; neighbours meet through aggregates and
    equi-joins, never as lists. Steps are cut by reliable checkpoints and repeated until nothing changes.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == before or mark["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = mark
        now = checkpointed(_star_step(now))
        sweep(now.sparkSession)
