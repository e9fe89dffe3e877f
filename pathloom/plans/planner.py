"""Choosing a strategy and a bucket width from a graph's statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.lineage import checkpointed
from pathloom.operators.stats import weight_estimate

#: Fixed values of the rules: degree spread of a power law, mean degree of a dense graph, least vertices and largest cut ratio for
#: the queue choice, buckets, the initial divisor of the bucket width and its least value.
SKEWED_DEGREES = 10
DENSE_DEGREE = 3
CUT_VERTICES = 300_000
CUT_RATIO = 0.0007
BAGS = 32
DELTA_DIVISOR = 32
LEAST_DELTA = 4

#: The names of two-level queues that a solve accepts.
QUEUE_NAMES = (
    "L1V_L2DQ", "L1N_L2DQ", "L1NF_L2DQ", "L1V_L2V", "L1N_L2V", "L1NF_L2V", "L1FQ_L2DQ", "L1V_L2PQ", "L1NF_L2PQ", "L1FQ_L2PQ", "L1V_L2MPQ",
    "L1NF_L2MPQ", "L1FQ_L2MPQ", "L1HQ_L2V", "L1HQ_L2DQ", "L1FQ_L2V", "L1N_L2MV", "L1N_L2BV", "L1V_L2BV", "L1SLF_L2DQ", "L1SLF_L2V",
)


def queue_strategy(name: str) -> str:
    """The expansion strategy that orders work as the queue does. The second level holds all open work, so its order decides: buckets, one heap, or a heap
    for each part. Plain vectors have no order of their own; there the first level decides: near and far, a filter of each part, small labels first within owners, or none."""
    if name not in QUEUE_NAMES:
        raise ValueError(f"{name} is not a queue")
    first, second = name.split("_")
    ordered = {"L2DQ": "delta", "L2PQ": "topk", "L2MPQ": "multi_topk"}
    return ordered.get(second) or {"L1NF": "near_far", "L1FQ": "filter", "L1SLF": "owner"}.get(first, "frontier")


QUEUES = {name: queue_strategy(name) for name in QUEUE_NAMES}


@dataclass(frozen=True)
class Choice:
    strategy: str
    delta: float | None


def initial_delta(avg_weight: float, avg_degree: float) -> int:
    """The power of two nearest to (weight / degree) / 32, the larger on a tie; 4 at least."""
    wanted = avg_weight / avg_degree / DELTA_DIVISOR if avg_degree else 0.0
    high = 1
    while high < wanted:
        high *= 2
    low = high // 2
    return max(LEAST_DELTA, low if wanted - low < high - wanted else high)


def bag(distance: float, base: float, shift: int) -> int:
    """The bag of a distance relative to the current one, 0 to 31, with bags 2 ** shift wide."""
    return min(max(int(distance // 2**shift) - int(base // 2**shift), 0), BAGS - 1)


def bucket(distance: float, base: float, delta: float, buckets: int) -> int:
    return min(max(int((distance - base) // delta), 0), buckets - 1)


def adaptive(avg_degree: float, dev_degree: float, avg_weight: float, dev_weight: float, delta: float | None = None) -> Choice:
    """By degrees: a wide spread asks for buckets, a dense graph for whole frontiers, a sparse one for near and far."""
    if dev_degree > SKEWED_DEGREES:
        return Choice("delta", delta or max(avg_weight - dev_weight, 1))
    if avg_degree > DENSE_DEGREE:
        return Choice("frontier", None)
    return Choice("near_far", delta or max(avg_weight * 5, 1))


def by_cut(vertices: int, crossing: int, edges: int) -> str | None:
    """Bucketed frontiers where a large graph is cut by few edges; else no override."""
    return "delta" if vertices >= CUT_VERTICES and edges and 0 < crossing / edges < CUT_RATIO else None


def for_diameter(levels: int, vertices: int) -> str:
    """Many levels: owners solve their parts locally, so a round per crossing and not per level."""
    return "owner" if levels > 64 and levels * levels > vertices**0.5 else "frontier"


def bag_of(distance: Column, base: float, shift: int) -> Column:
    """bag for a column of distances."""
    return F.least(F.greatest(F.floor(distance / 2**shift) - int(base // 2**shift), F.lit(0)), F.lit(BAGS - 1)).cast("int")


def sampled_delta(edges: DataFrame, vertices: int, stride: int = 16) -> int:
    """initial_delta from a stride sample: its size gives the degree, its mean the weight. A sample too small to tell gives the least width."""
    s = weight_estimate(edges, stride).first()
    return initial_delta(s["avg_weight"], s["sampled"] * stride / vertices) if s["sampled"] and vertices else LEAST_DELTA


def probed(edges: DataFrame, root: int, vertices: int, most: int | None = None) -> str:
    """owner or frontier, by the number of levels that a breadth-first probe from root finds. The probe ends where no further level could change what for_diameter says, unless `most` ends it before."""
    known = found = edges.sparkSession.createDataFrame([(root,)], "v long")
    levels = 0
    while for_diameter(levels, vertices) != "owner" and levels != most:
        found = checkpointed(found.join(edges, found["v"] == F.col("src")).select(F.col("dst").alias("v")).distinct().join(known, "v", "left_anti"))
        if found.isEmpty():
            break
        known, levels = checkpointed(known.unionByName(found)) if levels % 8 == 7 else known.unionByName(found), levels + 1
    return for_diameter(levels, vertices)
