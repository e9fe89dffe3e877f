"""Stored adjacency: edges in buckets of their source, the edges of a hub in blocks.

An edge's key is the hash of its source and a block number. A vertex of up to `block_edges` edges has one block, a hub as many as its edges need, dealt by a hash of the edge; so
no bucket holds more of a hub than a few blocks. Rows that are to be expanded get the keys of all blocks of their vertex and move to the buckets; edges never move.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.hashing import hash_of
from pathloom.functions.lineage import Stored, checkpointed
from pathloom.operators.graph import check

#: Edges of a vertex that stay together.
BLOCK_EDGES = 1 << 16
#: Hubs whose table may be broadcast.
FEW_HUBS = 100_000
#: Edges of a bucket, about.
BUCKET_EDGES = 1 << 21


def local_rows(spark, rows: list[tuple], kinds: dict[str, str]) -> DataFrame:
    """A few rows as a table that needs no job: numbers of the kinds long and double."""
    types = {"long": pa.int64(), "double": pa.float64()}
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds.values())], names=list(kinds)))


#: Lets a bucket of one file count as sorted, so a join does not sort it again.
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def in_order(spark):
    """Tables in buckets are read in the order that they were written in by what is planned meanwhile."""
    had = spark.conf.get(IN_ORDER, None)
    spark.conf.set(IN_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(IN_ORDER, had) if had is not None else spark.conf.unset(IN_ORDER)


def among(column: str, keys: list[int]) -> Column:
    """Whether the column is one of some numbers; written as one expression, which thousands of literals are not."""
    return F.expr(f"{column} IN ({', '.join(f'{k}L' if k != -(1 << 63) else '-9223372036854775807L - 1L' for k in keys)})") if keys else F.lit(False)


class Adjacency:
    """Edges (src, dst, weight) written by key, until dropped. kind is the type of weights; heavy_over parts edges heavier than that from the others."""

    def __init__(self, edges: DataFrame, kind: str, block_edges: int = BLOCK_EDGES, heavy_over: float | None = None, purpose: str = "edges"):
        self.spark, self.kind, self.parted = edges.sparkSession, kind, heavy_over is not None
        plain = edges.select("src", "dst", F.col("weight").cast(kind).alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            check(plain)
            degrees = plain.groupBy(F.col("src").alias("hub")).agg(F.count(F.lit(1)).alias("degree"), F.max("weight").alias("top"))
            hub = F.col("degree") > block_edges
            seen = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"), F.count(F.lit(1)).alias("sources"), F.count_if(hub).alias("hubs"), F.max("top").alias("top"), F.max("degree").alias("most")).first()
            #: The greatest weight, and the most blocks of a vertex.
            self.top_weight, self.most_blocks = seen["top"] or 0, max(1, -(-(seen["most"] or 0) // block_edges))
            self.hub_count, self.mean_degree = seen["hubs"], seen["edges"] / max(1, seen["sources"])
            self.hubs = degrees.where(hub).select("hub", F.ceil(F.col("degree") / block_edges).cast("long").alias("blocks"))
            self.hubs = checkpointed(self.hubs) if self.hub_count else None
            #: The hubs by id, unless there are too many to hold.
            self.hub_ids = None if self.hub_count > FEW_HUBS else {r["hub"] for r in self.hubs.select("hub").collect()} if self.hub_count else set()
            keyed = plain
            if self.hub_count:
                block = F.pmod(F.xxhash64("dst", "weight"), F.coalesce("blocks", F.lit(1).cast("long")))
                keyed = plain.join(self._near(self.hubs), F.col("src") == F.col("hub"), "left").withColumn("block", block)
            key = F.xxhash64("src", F.col("block") if self.hub_count else F.lit(0).cast("long"))
            out = keyed.select(key.alias("k"), F.col("src").alias("s"), F.col("dst").alias("t"), F.col("weight").alias("w"), *([(F.col("weight") > heavy_over).alias("heavy")] if self.parted else []))
            least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.buckets = max(least, -(-seen["edges"] // BUCKET_EDGES))
            self.stored = Stored(out, purpose, ("k", self.buckets), "heavy" if self.parted else None)
        finally:
            plain.unpersist()

    def _near(self, hubs: DataFrame) -> DataFrame:
        return F.broadcast(hubs) if self.hub_count <= FEW_HUBS else hubs

    def frame(self, heavy: bool | None = None) -> DataFrame:
        return self.stored.frame if heavy is None else self.stored.frame.where(F.col("heavy") == heavy)

    def around(self, rows: DataFrame) -> DataFrame:
        """rows(q, v, dist, hops) with k: one row for each block of edges of v."""
        if not self.hub_count:
            return rows.withColumn("k", F.xxhash64("v", F.lit(0).cast("long")))
        met = rows.join(self._near(self.hubs), F.col("v") == F.col("hub"), "left")
        return met.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1))).withColumn("k", F.xxhash64("v", "block")).drop("hub", "blocks", "block")

    def expand(self, rows: DataFrame, heavy: bool | None = None, tail: str | None = None, near: bool = False) -> DataFrame:
        """q, v, dist, hops offered to the heads of the edges of rows(q, v, dist, hops); with tail a column of that name has the vertex that offers. Only rows move: the join is on the key alone, by which the edges lie. near: rows, a bounded number, are sent to all edges."""
        around = self.around(rows)
        met = (F.broadcast(around) if near else around).alias("r").join(self.frame(heavy).alias("e"), F.col("r.k") == F.col("e.k")).where(F.col("r.v") - F.col("e.s") == 0)
        return met.select("q", F.col("t").alias("v"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"), *([F.col("e.s").alias(tail)] if tail else []))

    def of_few(self, vertices: list[int], most: int, heavy: bool | None = None) -> list | None:
        """The edges (s, t, w) of a few vertices that are no hubs, read from their buckets; None if there are more than that."""
        got = self.frame(heavy).where(among("k", [hash_of(v, 0) for v in vertices])).select("s", "t", "w").limit(most + 1).collect()
        return got if len(got) <= most else None

    def drop(self) -> None:
        self.stored.drop()


class Layers:
    """Adjacencies of the same vertices side by side, as edges arrive: a round reads them all, and none is written again."""

    def __init__(self, spark):
        self.spark, self.parts = spark, []

    def add(self, part: Adjacency) -> None:
        self.parts.append(part)

    @property
    def kind(self) -> str:
        return "double" if any(x.kind == "double" for x in self.parts) else "long"

    @property
    def mean_degree(self) -> float:
        """Not less than that of the union."""
        return sum(x.mean_degree for x in self.parts)

    @property
    def top_weight(self) -> float:
        return max((x.top_weight for x in self.parts), default=0)

    @property
    def most_blocks(self) -> int:
        return max((x.most_blocks for x in self.parts), default=1)

    @property
    def hub_ids(self) -> set | None:
        """What is a hub in one of them."""
        return None if any(x.hub_ids is None for x in self.parts) else set().union(*(x.hub_ids for x in self.parts))

    def expand(self, rows: DataFrame, heavy: bool | None = None, tail: str | None = None, near: bool = False) -> DataFrame:
        return reduce(DataFrame.unionByName, [x.expand(rows, heavy, tail, near) for x in self.parts])

    def of_few(self, vertices: list[int], most: int, heavy: bool | None = None) -> list | None:
        found = []
        for x in self.parts:
            got = x.of_few(vertices, most - len(found), heavy)
            if got is None:
                return None
            found += got
        return found

    def drop(self) -> None:
        for x in self.parts:
            x.drop()
        self.parts = []
