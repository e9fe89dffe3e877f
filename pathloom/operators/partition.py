"""Ranges of vertex ids for owners, and what crosses between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.search import place
from pathloom.operators.graph import out_degrees

RUN = 4096


def vertex_balanced(n: int, parts: int) -> list[int]:
    """First ids of the parts 0..parts and n at the end: n * i / parts rounded down."""
    return [n * i // parts for i in range(parts + 1)]


def cut_percent(n: int, percent: int | None) -> list[int]:
    """Two parts with the cut at `percent` of n, within 1..n-1; halves if percent isn't in 1..99."""
    cut = n * percent // 100 if percent is not None and 1 <= percent <= 99 else n // 2
    return [0, max(1, min(n - 1, cut)) if n > 1 else n, n]


def row_starts(edges: DataFrame, n: int) -> DataFrame:
    """id, first: the number of edges of smaller ids. Sums over runs of ids first, so no window holds all vertices."""
    degrees = edges.sparkSession.range(n).join(out_degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("d")).withColumn("run", F.floor(F.col("id") / RUN))
    runs = degrees.groupBy("run").agg(F.sum("d").alias("s"))
    base = runs.select("run", F.coalesce(F.sum("s").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("d").over(Window.partitionBy("run").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return degrees.withColumn("w", within).join(base, "run").select("id", (F.col("base") + F.col("w")).cast("long").alias("first"), F.col("d").cast("long").alias("degree"))


def edge_balanced(edges: DataFrame, n: int, parts: int) -> list[int]:
    """Bounds whose parts hold about as many edges: the id whose first edge is nearest to edges * i / parts, each part at least one id."""
    if n <= parts or parts <= 1:
        return vertex_balanced(n, parts)
    m = edges.count()
    # Every vertex names the goals that fall into its row: goal i is the edge m * i / parts.
    first, last = F.col("first"), F.col("first") + F.col("degree")
    named = row_starts(edges, n).where("degree > 0").select("id", "first", "degree", F.explode(F.sequence(F.floor(first * parts / m), F.ceil(last * parts / m) + 1)).alias("part"))
    goal = F.floor(F.lit(m) * F.col("part") / parts)
    hits = named.where(F.col("part").between(1, parts - 1) & (goal > first) & (goal <= last)).select("part", "id", (goal - first).alias("down"), (last - goal).alias("up"))
    bounds = {r["part"]: r["id"] if r["id"] > 0 and r["id"] + 1 < n and r["down"] <= r["up"] else r["id"] + 1 for r in hits.collect()}  # one row per part
    return [0, *(min(max(bounds.get(i, 0), i), n - (parts - i)) for i in range(1, parts)), n]


def owner(column: Column, bounds: list[int]) -> Column:
    """The part of an id, by binary search over the bounds: one number per part."""
    return F.coalesce(place(column, bounds[1:-1]), F.lit(0)).cast("int")


def owned_edges(edges: DataFrame, bounds: list[int], part: int) -> DataFrame:
    return edges.where((F.col("src") >= bounds[part]) & (F.col("src") < bounds[part + 1]))


def boundary_vertices(edges: DataFrame, bounds: list[int]) -> DataFrame:
    """v, owner: destinations of edges that come from another owner."""
    crossing = edges.where(owner(F.col("src"), bounds) != owner(F.col("dst"), bounds))
    return crossing.select(F.col("dst").alias("v"), owner(F.col("dst"), bounds).alias("owner")).distinct()


def remote_candidates(dist: DataFrame, edges: DataFrame, bounds: list[int]) -> DataFrame:
    """dst, d: the least distance that another owner offers to each vertex, combined before the exchange."""
    crossing = edges.where(owner(F.col("src"), bounds) != owner(F.col("dst"), bounds))
    offers = dist.join(crossing, dist["v"] == crossing["src"]).select("dst", (F.col("dist") + F.col("weight")).alias("d"))
    return offers.groupBy("dst").agg(F.min("d").alias("d"))


def ghost_closure(edges: DataFrame, bounds: list[int], part: int, depth: int) -> DataFrame:
    """v: vertices of other owners within `depth` hops of what `part` reaches across its bounds."""
    mine = (F.col("src") >= bounds[part]) & (F.col("src") < bounds[part + 1])
    inside = (F.col("dst") >= bounds[part]) & (F.col("dst") < bounds[part + 1])
    found = edges.where(mine & ~inside).select(F.col("dst").alias("v")).distinct()
    for _ in range(depth - 1):
        more = edges.where(~inside).join(found, edges["src"] == found["v"], "left_semi").select(F.col("dst").alias("v"))
        found = found.union(more).distinct()
    return found
