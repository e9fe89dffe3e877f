"""Decrease-only updates: new or lighter edges can only shorten distances, so a batch starts from what it improves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.lineage import Stored, checkpointed
from pathloom.operators import sssp
from pathloom.operators.adjacency import Adjacency, Layers

#: State that lies on an executor's disk: in the default store every edge is an object of its heap.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def absorb(solved: DataFrame, edges: DataFrame | Layers, new_edges: DataFrame | Adjacency, seeds: DataFrame, strategy: str = "frontier", **options) -> DataFrame:
    """q, v, dist, hops after new_edges joined the graph; edges already holds them.

    Both may be stored adjacency, whose edges do not move. Only heads of new edges that offer less than a vertex has are seeds of the update; what they reach merges with the former distances.
    """
    if isinstance(new_edges, Adjacency):
        offers = new_edges.expand(solved.select("q", "v", "dist", "hops")).select("q", "v", "dist")
    else:
        at = solved.select("q", F.col("v").alias("u"), "dist", "hops")
        offers = at.join(new_edges.hint("merge"), F.col("u") == F.col("src")).select("q", F.col("dst").alias("v"), (F.col("dist") + F.col("weight")).alias("dist"))
    better = offers.groupBy("q", "v").agg(F.min("dist").alias("dist")).join(solved.select("q", "v", F.col("dist").alias("had")), ["q", "v"], "left").where("had IS NULL OR dist < had").select("q", "v", "dist")
    found = sssp.solve(edges, checkpointed(better), strategy, **options)
    merged = solved.select("q", "v", "dist", "hops").unionByName(found)
    return checkpointed(merged.groupBy("q", "v").agg(F.min(F.struct("dist", "hops")).alias("m")).select("q", "v", "m.dist", "m.hops"))


def replay(edges: DataFrame, batches: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """The distances after all batches, kept up to date batch by batch. hops count from the latest update's seeds."""
    solved, all_edges = sssp.solve(edges, seeds), edges
    for b in batches:
        all_edges = checkpointed(all_edges.unionByName(b))
        solved = absorb(solved, all_edges, b, seeds)
    return solved


class Followed:
    """Distances from seeds(q, v, dist) over a stream of edges (src, dst, weight) that may repeat.

    The least weight of each (src, dst) is state that the stream keeps in its checkpoint, on disk while it runs. A micro-batch hands on only the edges that are new or became lighter; they
    are written, as adjacency too, beside those of earlier batches, which stay as they are, and improve the distances from their heads on.
    """

    def __init__(self, spark, seeds: DataFrame):
        self.spark, self.seeds, self.kept, self.layers = spark, seeds, [], Layers(spark)
        self.solved = seeds.select("q", "v", "dist", F.lit(0).cast("long").alias("hops"))

    def edges(self) -> DataFrame:
        """All that was handed on; of the same edge the lighter one counts, which a shortest path takes anyway."""
        return reduce(DataFrame.unionByName, self.kept)

    def start(self, stream: DataFrame, checkpoint: str, both_ways: bool = False):
        """The running query; it ends when the source has nothing more. both_ways: each edge counts in both directions, and is one row of the state."""
        least = stream.groupBy("src", "dst").agg(F.min("weight").alias("weight"))

        def each(batch: DataFrame, _: int) -> None:
            ends = F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
            held = Stored(batch.select(ends, "weight") if both_ways else batch, "arrived")
            if held.about:
                # A micro-batch has a session of its own; what is read again belongs to the solves' session.
                new = self.spark.read.schema(batch.schema).parquet(held.path)
                self.kept.append(new)
                self.layers.add(Adjacency(new, "double" if dict(new.dtypes)["weight"] in ("double", "float") else "long", purpose="arrived_edges"))
                self.solved = absorb(self.solved, self.layers, self.layers.parts[-1], self.seeds)

        had = {k: self.spark.conf.get(k, None) for k in STORE}
        try:
            # A stream copies the settings of its session as it starts.
            for k, v in STORE.items():
                self.spark.conf.set(k, v)
            return least.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        finally:
            for k, v in had.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

    def distances(self) -> DataFrame:
        return self.solved

    def close(self) -> None:
        """Delete the adjacency; the distances stay."""
        self.layers.drop()
