"""Renumbering vertices in breadth-first order, and rebuilding the graph by it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from pathloom.functions.lineage import Stored, checkpointed, shared_folder
from pathloom.functions.ranking import buckets_for, ordered_rank, running_total
from pathloom.operators import sssp
from pathloom.operators.graph import in_order


def _rank_levels(first: int):
    """Edges (src, dst, pos, level) of consecutive levels, and the order (old_id, new_id) of the level before them -> new_id, old_id, level, numbered from `first` on."""

    def run(edges: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(edges["level"].to_numpy(), kind="stable")
        src, dst, pos, level = (edges[c].to_numpy()[order] for c in ("src", "dst", "pos", "level"))
        ids, ranks, at, out = parents["old_id"].to_numpy(), parents["new_id"].to_numpy(), first, []
        cuts = np.flatnonzero(np.diff(level, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(level)], strict=True):
            by_id = np.argsort(ids)
            parent = ranks[by_id][ids[by_id].searchsorted(src[lo:hi])]
            # Of a vertex's finders the earliest, then vertices by that.
            best = np.lexsort((pos[lo:hi], parent, dst[lo:hi]))
            best = best[np.flatnonzero(np.diff(dst[lo:hi][best], prepend=-1))]
            ids = dst[lo:hi][best[np.lexsort((pos[lo:hi][best], parent[best]))]]
            ranks = np.arange(at, at + len(ids))
            out.append(pd.DataFrame({"new_id": ranks, "old_id": ids, "level": level[lo]}))
            at += len(ids)
        return pd.concat(out)

    return run


def bfs_order(edges: DataFrame, n: int, root: int = 0, run_edges: int = 1 << 18) -> DataFrame:
    """new_id, old_id, level: the order in which a queue finds vertices; edges of a row in the order of eid.

    A vertex is found by the earliest parent and there by its earliest edge. What the root doesn't reach follows by old id
    with a null level. Levels come from a solve by owners. Then only edges from one level to the next matter: they lie by level, a wide level in ranges of its parents, and consecutive levels with at most
    `run_edges` of them together are ranked in one task, a wider level by a join. So rounds count such runs, each edge is read in one of them, and nothing found is written again.
    """
    if not 0 <= root < n:
        raise ValueError("the root is not a vertex")
    spark = edges.sparkSession
    reached = checkpointed(sssp.solve(edges.select("src", "dst", F.lit(1).cast("long").alias("weight")), sssp.sources_frame(edges, [root]), "owner", n=n).select("v", F.col("dist").cast("int").alias("level")))
    placed = in_order(edges.where(F.col("src") != F.col("dst"))).select("src", "dst", F.col("pos").cast("long").alias("pos"))
    above, below = reached.select(F.col("v").alias("src"), F.col("level").alias("_up")), reached.select(F.col("v").alias("dst"), "level")
    down = Stored(placed.join(above, "src").join(below, "dst").where("level = _up + 1").select("src", "dst", "pos", "level").repartitionByRange("level", "src", "pos").sortWithinPartitions("level"), "layers")
    folder = shared_folder(spark, "order")
    kinds = "new_id long, old_id long, level int"
    at = lambda i: f"{folder}/run={i}"
    spark.createDataFrame([(0, root, 0)], kinds).coalesce(1).write.parquet(at(0))
    try:
        levels = reached.groupBy("level").agg(F.count(F.lit(1)).alias("vertices")).join(down.frame.groupBy("level").agg(F.count(F.lit(1)).alias("edges")), "level")
        top = reached.agg(F.max("level"), F.count(F.lit(1))).first()
        sized = running_total(levels.withColumn("_all", F.lit(0)), ["_all"], F.col("level").cast("long"), ["level"], F.col("edges"), "upto", buckets_for(top[0] + 1), max(1, int(top[0]).bit_length()))
        wide = F.col("edges") > run_edges
        runs = sized.groupBy(F.floor(F.col("upto") / run_edges).alias("part"), F.when(wide, F.col("level")).alias("alone")).agg(F.min("level").alias("lo"), F.max("level").alias("hi"), F.sum("vertices").alias("vertices")).orderBy("lo")
        count = 1
        for i, r in enumerate(runs.collect(), 1):  # at most two for each run_edges edges, and one
            own = down.frame.where(F.col("level").between(r["lo"], r["hi"]))
            before = spark.read.schema(kinds).parquet(at(i - 1)).where(F.col("level") == r["lo"] - 1)
            if r["alone"] is None:
                needed = before.join(own.where(F.col("level") == r["lo"]).select(F.col("src").alias("old_id")), "old_id", "left_semi").select("old_id", "new_id")
                one = lambda rows: rows.withColumn("_all", F.lit(0)).groupBy("_all")
                ranked = one(own).cogroup(one(needed)).applyInPandas(_rank_levels(count), kinds)
            else:
                found = before.join(own, F.col("old_id") == F.col("src")).groupBy("dst").agg(F.min(F.struct("new_id", "pos")).alias("by")).select("dst", F.col("by.new_id").alias("parent"), F.col("by.pos").alias("pos"))
                ranked = ordered_rank(found, "parent", ["pos", "dst"], "nth").select((F.col("nth") + count).alias("new_id"), F.col("dst").alias("old_id"), F.lit(r["lo"]).alias("level"))
            ranked.write.parquet(at(i))
            count += r["vertices"]
    finally:
        down.drop()
    found = spark.read.schema(f"{kinds}, run int").parquet(folder).drop("run")
    rest = spark.range(n).withColumnRenamed("id", "old_id").join(reached.select(F.col("v").alias("old_id")), "old_id", "left_anti")
    rest = ordered_rank(rest, "old_id", [], "nth").select((F.col("nth") + count).alias("new_id"), "old_id", F.lit(None).cast("int").alias("level"))
    return found.unionByName(rest)


def layer_split(order: DataFrame, n: int) -> DataFrame:
    """new_id, old_id: each level halved in the order of discovery, exactly n // 2 vertices in the first part. Unreached vertices are one last level.

    The sums over levels see one row per level.
    """
    cut = n // 2
    levels = order.groupBy("level").agg(F.min("new_id").alias("begin"), (F.max("new_id") + 1).alias("end"))
    before = Window.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    # Up to the end of a level min(cut, (end + 1) / 2) vertices are in the first part.
    levels = levels.withColumn("upto", F.least(F.lit(cut), F.floor((F.col("end") + 1) / 2)).cast("long"))
    levels = levels.withColumn("left", F.coalesce(F.max("upto").over(before), F.lit(0)).cast("long")).withColumn("take", F.greatest(F.col("upto") - F.col("left"), F.lit(0)))
    # What of [0, begin) is not in the first part is in the second.
    spans = levels.select(F.col("begin").alias("b"), F.col("end").alias("e"), F.col("left").alias("l"), "take", F.col("level").alias("lv"))
    met = order.join(spans, F.col("level").eqNullSafe(F.col("lv")))
    nth = F.col("new_id") - F.col("b")
    place = F.when(nth < F.col("take"), F.col("l") + nth).otherwise(F.lit(cut) + (F.col("b") - F.col("l")) + nth - F.col("take"))
    return met.select(place.cast("long").alias("new_id"), "old_id")


class RowSizes:
    """How many edges each row has, counted in one pass and stored: frame(src, d). edges is their number, most the largest row's, least and top the ends' bounds (None without edges)."""

    def __init__(self, edges: DataFrame):
        watch = Observation()
        seen = edges.observe(watch, F.min(F.least("src", "dst")).alias("least"), F.max(F.greatest("src", "dst")).alias("top"))
        sized = seen.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
        self.stored = Stored(sized, "rows", seen={"edges": F.sum("d"), "most": F.max("d")})
        self.frame, self.edges, self.most = self.stored.frame, self.stored.seen["edges"] or 0, self.stored.seen["most"] or 0
        # Without rows what was observed below the shuffle may be left out.
        self.least, self.top = (watch.get["least"], watch.get["top"]) if self.edges else (None, None)

    def drop(self) -> None:
        self.stored.drop()


def _covers(mapping: DataFrame, sizes: RowSizes) -> int | None:
    """The greatest new id if the mapping gives each id from its least to its greatest, and all ends of edges, a new id of its own; else None."""
    ids = [F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("old_id", "new_id") for k, f in (("own", F.count_distinct), ("lo", F.min), ("hi", F.max))]]
    x = mapping.agg(*ids).first()
    if not x["n"] or not x["n"] == x["own_old_id"] == x["own_new_id"] == x["hi_old_id"] - x["lo_old_id"] + 1 or x["lo_new_id"] < 0:
        return None
    return x["hi_new_id"] if sizes.edges and x["lo_old_id"] <= sizes.least and sizes.top <= x["hi_old_id"] else None


def rebuild(edges: DataFrame, mapping: DataFrame, sizes: RowSizes | None = None, most: int = 1 << 20) -> DataFrame:
    """edges with both ends renumbered; rows follow the new ids, within a row the old order. Edges whose ends the mapping lacks are left out.

    A row's first eid is the sum of the rows before it, over vertices. So edges move twice: to the new ids of their heads, and to their row, where they are numbered
    and get its new id. Both joins are merged at any size. A mapping that lacks or repeats ids, or a row of more than `most` edges, takes joins and an
    ordered rank over edges instead. sizes, if given, are those of edges and not counted again.
    """
    own = sizes or RowSizes(edges)
    top = _covers(mapping, own) if own.most <= most else None
    if top is None:
        return _rebuild_any(edges, mapping)
    to_map = mapping.select(F.col("old_id").alias("_p"), F.col("new_id").alias("_dst")).hint("merge")
    rows = checkpointed(own.frame.join(mapping, F.col("src") == F.col("old_id")).select(F.col("src").alias("_o"), F.col("new_id").cast("long").alias("_src"), "d", F.lit(0).alias("_all")))
    first = running_total(rows, ["_all"], F.col("_src"), ["_src"], F.col("d"), "_first", buckets_for(rows.count()), max(1, int(top).bit_length()))
    first = checkpointed(first.select("_o", "_src", "_first"))
    moved = edges.join(to_map, F.col("dst") == F.col("_p")).select("src", "_dst", "weight", F.col("eid").alias("_old"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy("_old"))
    met = moved.withColumn("_nth", nth).join(first.hint("merge"), F.col("src") == F.col("_o"))
    return met.select((F.col("_first") + F.col("_nth") - 1).alias("eid"), F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight")


def _rebuild_any(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    from_map = mapping.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_src"))
    to_map = mapping.select(F.col("old_id").alias("_p"), F.col("new_id").alias("_dst"))
    moved = edges.join(from_map, F.col("src") == F.col("_o")).join(to_map, F.col("dst") == F.col("_p")).select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight", "eid")
    return ordered_rank(moved.withColumnRenamed("eid", "_old"), "src", ["_old"], "eid").select("eid", "src", "dst", "weight")


def check_mapping(edges: DataFrame, rebuilt: DataFrame, mapping: DataFrame, n: int, sizes: RowSizes | None = None) -> None:
    """Raise ValueError unless the mapping is a permutation of 0..n-1 and edges and degrees are preserved. sizes, if given, are those of edges and not counted again."""
    ids = mapping.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("new_id").alias("a"), F.count_distinct("old_id").alias("b"), F.min("new_id").alias("lo"), F.max("new_id").alias("hi")).first()
    if n and tuple(ids) != (n, n, n, 0, n - 1):
        raise ValueError("the mapping is not a permutation")
    had = sizes.frame if sizes else edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    old = had.join(mapping, F.col("src") == F.col("old_id")).select("new_id", "d")
    new = rebuilt.groupBy(F.col("src").alias("new_id")).agg((-F.count(F.lit(1))).alias("d"))
    if old.unionByName(new).groupBy("new_id").agg(F.sum("d").alias("d")).where("d <> 0").limit(1).count():
        raise ValueError("degrees changed")
