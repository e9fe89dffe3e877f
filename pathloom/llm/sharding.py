"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of cells. A key belongs to the arc that ends at the next point clockwise. Arcs, in the order
of the ring, fill their own shard up to its capacity; what a full shard cannot take continues clockwise. The room that other
shards have left lies evenly at their points, and each point takes from what passes until its room is used. The capacities bound every
load; with load_factor None they are exact (counts at most one apart). Only the overflow moves away from the plain ring position.

What passes a point is a queue: its length is the running sum of overflow less room, less that sum's least value so far. So windows over
the points, n_shards * vnodes rows, find all moves; rows then find their block by their rank within the arc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.lineage import checkpointed

#: Cells of the ring for each point, and at least so many.
CELLS_PER_POINT = 16
CELLS = 1 << 14
#: Rows of a table of cells that may be broadcast.
FEW = 1 << 16


def _ring(spark, n_shards: int, vnodes: int, cells: int) -> DataFrame:
    """cell -> arc (0, 1, ... in ring order), shard of the arc, clockwise place of the cell within the arc. At most `cells` rows."""
    points = spark.range(n_shards * vnodes).select((F.col("id") % n_shards).cast("int").alias("shard"), F.floor(F.col("id") / n_shards).alias("v"))
    points = points.withColumn("cell", F.pmod(F.xxhash64(F.lit("vnode"), "shard", "v"), F.lit(cells)))
    # Points that fall into one cell: the smallest (hash, shard, v) owns the arc there.
    points = points.groupBy("cell").agg(F.min(F.struct(F.xxhash64("v", "shard").alias("x"), "shard", "v")).alias("own"))
    points = points.select("cell", F.col("own.shard").alias("shard"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cell")) - 1).alias("arc"))
    # From the last cell down, the latest point seen is the next one clockwise.
    ahead = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    at = F.struct("arc", "shard", F.col("at").alias("at"))
    table = spark.range(cells).select(F.col("id").alias("cell")).join(points.withColumn("at", F.col("cell")), "cell", "left")
    table = table.withColumn("own", F.when(F.col("arc").isNotNull(), at))
    table = table.withColumn("own", F.coalesce(F.last("own", ignorenulls=True).over(ahead), F.min("own").over(whole)))
    return table.select("cell", F.col("own.arc").alias("arc"), F.col("own.shard").alias("home"), F.pmod(F.col("cell") - F.col("own.at") - 1, F.lit(cells)).alias("place"))


def _blocks(arcs: DataFrame, n_shards: int, load_factor: float | None) -> DataFrame:
    """arc, lo, n, shard, slot: rows lo to lo + n - 1 of an arc go to slots from `slot` on of a shard. arcs(arc, home, n) has a row per point; shards without one hold nothing of their own."""
    spark = arcs.sparkSession
    one = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(one)
    s = F.col("shard")
    load = F.floor(total / n_shards) + F.when(s < total % n_shards, 1).otherwise(0) if load_factor is None else F.ceil(F.lit(float(load_factor)) * total / n_shards)
    # A shard whose points all lost their cells to others still has room: it gets a point of its own at the end of the ring.
    bare = spark.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(arcs.select(F.col("home").alias("shard")).distinct(), "shard", "left_anti")
    last = F.lit(1 << 40) + F.col("shard")
    points = arcs.select("arc", F.col("home").alias("shard"), "n").unionByName(bare.select(last.alias("arc"), "shard", F.lit(0).cast("long").alias("n")))
    points = points.withColumn("cap", load.cast("long"))
    mine, before = Window.partitionBy("shard").orderBy("arc"), Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("had", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("load", F.least("cap", F.sum("n").over(Window.partitionBy("shard"))))
    points = points.withColumn("stay", F.greatest(F.lit(0).cast("long"), F.least("n", F.col("cap") - F.col("had")))).withColumn("over", F.col("n") - F.col("stay"))
    room, k, nth = F.col("cap") - F.col("load"), F.count(F.lit(1)).over(Window.partitionBy("shard")), F.row_number().over(mine) - 1
    points = points.withColumn("room", F.floor(room / k) + F.when(nth < room % k, 1).otherwise(0))
    own = points.where("stay > 0").select("arc", F.lit(0).cast("long").alias("lo"), F.col("stay").alias("n"), "shard", F.least("had", "cap").alias("slot"))
    # The ring is cut where least is on its way: what begins there ends before it comes round.
    ring = Window.partitionBy(F.lit(0)).orderBy("arc")
    points = points.withColumn("sum", F.sum(F.col("over") - F.col("room")).over(ring))
    cut = F.min(F.struct("sum", "arc")).over(one)["arc"]
    points = points.withColumn("turn", (F.col("arc") <= cut).cast("int"))
    way = Window.partitionBy(F.lit(0)).orderBy("turn", "arc")
    points = points.withColumn("sum", F.sum(F.col("over") - F.col("room")).over(way))
    points = points.withColumn("queue", F.col("sum") - F.least(F.lit(0), F.min("sum").over(way)))
    points = points.withColumn("took", F.coalesce(F.lag("queue").over(way), F.lit(0)) + F.col("over") - F.col("queue"))
    points = points.withColumn("out", F.sum("over").over(way) - F.col("over")).withColumn("in", F.sum("took").over(way) - F.col("took"))
    taken = F.coalesce(F.sum("took").over(Window.partitionBy("shard").orderBy("turn", "arc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    points = points.withColumn("first", F.col("load") + taken)
    # First come, first served: the queue's units in both orders, cut wherever either goes on to the next.
    leave = points.where("over > 0").select(F.col("out").alias("at"), F.struct("arc", "stay", "out").alias("f"), F.lit(None).cast("struct<shard:int,first:bigint,in:bigint>").alias("t"))
    enter = points.where("took > 0").select(F.col("in").alias("at"), F.lit(None).cast(leave.schema["f"].dataType).alias("f"), F.struct("shard", "first", "in").alias("t"))
    cuts = leave.unionByName(enter).groupBy("at").agg(F.max("f").alias("f"), F.max("t").alias("t"))
    along = Window.partitionBy(F.lit(0)).orderBy("at")
    end = F.coalesce(F.lead("at").over(along), F.lit(None))
    moved = cuts.withColumn("end", end).withColumn("f", F.last("f", True).over(along)).withColumn("t", F.last("t", True).over(along))
    whole = points.agg(F.sum("over").alias("all"))  # one row
    moved = moved.join(F.broadcast(whole)).withColumn("end", F.coalesce("end", "all"))
    moved = moved.select(F.col("f.arc").alias("arc"), (F.col("f.stay") + F.col("at") - F.col("f.out")).alias("lo"), (F.col("end") - F.col("at")).alias("n"), F.col("t.shard").alias("shard"), (F.col("t.first") + F.col("at") - F.col("t.in")).alias("slot"))
    return own.unionByName(moved)


def ring_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 64, load_factor: float | None = None, cells: int | None = None) -> DataFrame:
    """doc_id, size long, text_crc32 long, shard int, slot long (0, 1, ... in its shard): one row per row of docs.

    load_factor None: shard counts differ by at most one. Else no shard holds more than
    ceil(load_factor * rows / n_shards) rows (load_factor >= 1). Null ids are placed by their text; a null text has size 1 and the checksum of
    an empty one. Repeated rows are placed row by row; rows alike in id and text are interchangeable. Other
    columns of docs are not read. An empty table gives no rows.
    """
    if load_factor is not None and load_factor < 1:
        raise ValueError("load_factor must be at least 1")
    spark = docs.sparkSession
    cells = cells or max(CELLS, 1 << (CELLS_PER_POINT * n_shards * vnodes - 1).bit_length())
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("null"), "text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    # Small rows, cut here: the texts are read once.
    keyed = checkpointed(rows.withColumn("_h", h).withColumn("_cell", F.pmod("_h", F.lit(cells))))
    counted = keyed.groupBy(F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    ring = _ring(spark, n_shards, vnodes, cells)
    before = Window.partitionBy("arc").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # At most `cells` rows.
    held = ring.join(counted, ring["cell"] == counted["_c"], "left").select("cell", "arc", "home", "place", F.coalesce("n", F.lit(0)).alias("n"))
    held = checkpointed(held)
    offsets = held.where("n > 0").select(F.col("cell").alias("_c"), F.col("arc").alias("_arc"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    arcs = held.groupBy("arc").agg(F.first("home").alias("home"), F.sum("n").alias("n"))
    blocks = _blocks(arcs, n_shards, load_factor).select(F.col("arc").alias("_barc"), F.col("lo").alias("_lo"), (F.col("lo") + F.col("n")).alias("_hi"), "shard", F.col("slot").alias("_slot"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "doc_id", "text_crc32", "size")) - 1
    # Neither table grows with the input: `cells` rows, and at most three blocks a point.
    placed = keyed.withColumn("_rank", rank).join(F.broadcast(offsets) if cells <= FEW else offsets, F.col("_cell") == F.col("_c")).withColumn("_r", F.col("_rank") + F.col("_base"))
    placed = placed.join(F.broadcast(blocks), (F.col("_arc") == F.col("_barc")) & (F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi")))
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_slot") + F.col("_r") - F.col("_lo")).alias("slot"))


def op2_ring_shards(spark, sf_dir: str) -> DataFrame:
    out = ring_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
