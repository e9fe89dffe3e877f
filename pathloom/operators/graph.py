"""Building, checking and reading edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INT_MAX = 2**31 - 1


def from_pairs(pairs: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """edges out of one row per directed edge; eid numbers them by (src, dst, weight) without one global window."""
    from pathloom.functions.ranking import buckets_for, dense_rank_in

    plain = pairs.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), F.col(weight).alias("weight"))
    return dense_rank_in(plain.withColumn("_one", F.lit(0)), ["_one"], F.xxhash64("src"), ["src", "dst", "weight"], "eid", buckets_for(pairs.count())).select("eid", "src", "dst", "weight")


def check(edges: DataFrame, n: int | None = None) -> None:
    """Raise ValueError for null ends or weights, NaN or negative weights, and ends outside 0..n-1. Zero weights are allowed."""
    bad = F.col("src").isNull() | F.col("dst").isNull() | F.col("weight").isNull() | (F.col("weight") < 0)
    if dict(edges.dtypes)["weight"] in ("double", "float"):
        bad = bad | F.isnan("weight")
    if n is not None:
        bad = bad | ~F.col("src").between(0, n - 1) | ~F.col("dst").between(0, n - 1)
    first = edges.where(bad).limit(1).collect()
    if first:
        raise ValueError(f"edge not allowed: {first[0].asDict()}")


def out_degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, degree; with vertices, those without edges have degree 0."""
    found = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return found if vertices is None else vertices.join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def out_edges(edges: DataFrame, v: int) -> DataFrame:
    return edges.where(F.col("src") == v)


def valid_nodes(frame: DataFrame, column: str, n: int) -> DataFrame:
    return frame.where(F.col(column).between(0, n - 1))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, nbrs: array of (eid, dst, weight) in the order of eid."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("eid", "dst", "weight"))).alias("nbrs"))


def iterate_edges(adj: DataFrame) -> DataFrame:
    """The inverse of adjacency."""
    return adj.select("src", F.explode("nbrs").alias("e")).select("e.eid", "src", "e.dst", "e.weight")


def lightest_parallel(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the lightest, then the one with the smallest eid. Distances stay the same."""
    best = edges.groupBy("src", "dst").agg(F.min(F.struct("weight", "eid")).alias("e"))
    return best.select("e.eid", "src", "dst", "e.weight")


def cross_edges(edges: DataFrame, cut: int) -> DataFrame:
    """crossing, edges, ratio of the edges between ids below `cut` and the others."""
    crosses = (F.col("src") < cut) != (F.col("dst") < cut)
    counted = edges.agg(F.count_if(crosses).alias("crossing"), F.count(F.lit(1)).alias("edges"))
    return counted.select("crossing", "edges", F.when(F.col("edges") > 0, F.col("crossing") / F.col("edges")).alias("ratio"))


def min_combine(candidates: DataFrame) -> DataFrame:
    """dst, d: the least candidate per destination, combined before the shuffle."""
    return candidates.groupBy("dst").agg(F.min("d").alias("d"))


def in_order(edges: DataFrame) -> DataFrame:
    """Edges with pos, the place of the edge in its row (0, 1, ... by eid)."""
    return edges.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("eid")) - 1)
