"""Near copies by the Jaccard likeness of word shingles, found by prefix filtering: every pair that is like enough is linked.

The distinct shingles of a text are put in one order for all texts, those that a sample of texts shares most last. Two texts
of likeness t share t of the larger one's shingles at least, so they share one of the first n - ceil(t * n) + 1 shingles of each.
These prefixes meet in one shuffle. Before that, where fingerprints are given (near_copies' `radius`), SimHash fingerprints of the same shingles link what
differs in few bits, as far as whole shingle sets confirm it; prefixes then find what fingerprints miss. Texts with a shingle in common are first verified against one of its group, a
few times; whoever is not in one component after that is verified against each other, unless their parity sketches already differ
in more bits than their sets may differ in shingles. Equal shingle sets are one node.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.batches import bound_batches
from pathloom.functions.filters import WIDE, bits_for, key_filter
from pathloom.functions.lineage import checkpointed, sweep
from pathloom.llm import simhash
from pathloom.llm.components import connected_components

SHINGLE = 5
LIKENESS = 0.8
#: Rows of a text table that go through Python at a time.
ROWS = 256
#: How often the texts of a group are verified against one of them before all that are still apart are verified against each other.
ROUNDS = 1
#: Longs of a parity sketch. Each shingle flips one bit, so two sketches differ in at most as many bits as the sets do in shingles.
SKETCH = 8


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of every `size` consecutive words in lower case; fewer words are one shingle, none an empty array."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), dtype=np.uint64, count=len(words))
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    total = len(hashes) - size + 1
    out = np.full(total, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + total]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(27)))


def sketch(own: np.ndarray) -> np.ndarray:
    """The parity sketch of distinct hashes: SKETCH longs."""
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _least(likeness: float, n: int) -> int:
    return math.ceil(likeness * n - 1e-9)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("th"))


def common_shingles(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, sample: int = 10_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, that three or more of about `sample` distinct texts share, and how many; it decides an order, not what is found."""
    bound_batches(docs.sparkSession)
    n = docs.count()
    share = 1 << 20 if n <= sample else int((1 << 20) * sample / n)
    drawn = _texts(docs, text_col).where(F.pmod(F.xxhash64(F.lit("likeness"), "th"), F.lit(1 << 20)) < share).dropDuplicates(["th"])

    def run(batches):
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), size).view(np.int64))], names=["h"])

    counted = drawn.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    top = counted.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, count = top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], count[order]


def _prefixes(docs: DataFrame, id_col: str, text_col: str, likeness: float, size: int, prints: bool = False) -> DataFrame:
    """doc_id, th (hash of the text), node (hash of the shingle set), n (its size), prefix, sketch, fp (SimHash of the shingles, repeats included): one row per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, size))

    def run(batches):
        common, count = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                node, ns, prefix, sketches, fps = [], [], [], [], []
                for t in b.column("text").to_pylist():
                    own = shingles(t, size)
                    n = len(own)
                    if len(common):
                        i = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        ranked = own[np.lexsort((own, np.where(common[i] == own, count[i], 0)))]
                    else:
                        ranked = own
                    node.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
                    ns.append(n)
                    prefix.append(ranked[: n - _least(likeness, n) + 1 if n else 0].view(np.int64))
                    sketches.append(sketch(own))
                    fps.append(simhash.fingerprint(t, size) if prints else 0)
                cols = [b.column("doc_id"), b.column("th"), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(ns, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "node", "n", "prefix", "sketch", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("th"))
    return rows.mapInArrow(run, "doc_id long, th long, node long, n long, prefix array<long>, sketch array<long>, fp long")


def _verified(pairs: DataFrame, named: DataFrame, docs: DataFrame, text_col: str, likeness: float, size: int) -> DataFrame:
    """Those of pairs(a, b) whose whole shingle sets are like enough; named(node, th) has a text's hash for every node."""
    asked = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named, "node"))
    places = 1 << bits_for(asked.count())
    bits = np.zeros(places >> 3, dtype=np.uint8)
    # Bitmaps are made by aggregation: the driver gets as much as the filter has bits, at most.
    for r in key_filter(asked, F.col("th"), places.bit_length() - 1).toLocalIterator():
        own = np.frombuffer(r["_fm"], dtype=np.uint8)
        bits[r["_fb"] * WIDE >> 3 :][: len(own)] |= own
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                i = b.column("th").to_numpy() % places
                b = b.filter(pa.array((sent.value[i >> 3] >> (i & 7)) & 1 == 1))
                if b.num_rows:
                    sets = [shingles(t, size).view(np.int64) for t in b.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column("th"), pa.array(sets, pa.list_(pa.int64()))], names=["th", "grams"])

    read = _texts(docs, text_col).where("th IS NOT NULL").mapInArrow(run, "th long, grams array<long>")
    sets = checkpointed(read.join(asked, "th").dropDuplicates(["node"]).select("node", "grams"))
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    same = F.size(F.array_intersect("ga", "gb"))
    return met.where(same / (F.size("ga") + F.size("gb") - same) >= likeness).select("a", "b")


def _reachable(counted: DataFrame, likeness: float) -> DataFrame:
    """(a, b) of counted(a, b, na, nb, same) that may be like enough; same: how many shingles their prefixes share.

    Of the prefix that ends first in the order, what the other prefix lacks the other text lacks too.
    """
    most = F.greatest(F.ceil(likeness * F.col("na") - 1e-9), F.ceil(likeness * F.col("nb") - 1e-9)) - 1 + F.col("same")
    return counted.where(most >= likeness / (1 + likeness) * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b")


def _by_fingerprints(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs of nodes whose SimHash fingerprints are equal or linked at `radius` bits, one node standing for all of its fingerprint. Candidates, which whole shingle sets verify."""
    nodes = checkpointed(rows.where("n > 0").select("node", "n", "fp").distinct())
    first = checkpointed(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("m")).select("fp", F.col("m.node").alias("first"), F.col("m.n").alias("size")))
    same = nodes.join(first.hint("merge"), "fp").where(F.col("node") != F.col("first")).select("node", "first")
    linked = simhash.linked_pairs(first.select("fp"), radius)
    at = lambda c, out: first.select(F.col("fp").alias(c), F.col("first").alias(out)).hint("merge")
    apart = linked.join(at("a", "x"), "a").join(at("b", "y"), "b").select("x", "y")
    return same.union(apart).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_copies(docs: DataFrame, likeness: float = LIKENESS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """doc_id, th, root: equal for rows whose texts are linked, directly or over others. One row per row of docs.

    Texts link at a Jaccard likeness of `likeness` or more of their sets of `size`-word shingles. Texts without words are one component. With radius, SimHash
    fingerprints within that many bits are the first candidates; the result is the same.
    """
    rows = checkpointed(_prefixes(docs, id_col, text_col, likeness, size, radius is not None))
    named = rows.where("n > 0").groupBy("node").agg(F.min("th").alias("th"))
    by = Window.partitionBy("h")
    met = rows.where("n > 0").select("node", "n", F.explode("prefix").alias("h"))
    met = met.withColumn("lo", F.min("node").over(by)).withColumn("hi", F.max("node").over(by))
    shared = checkpointed(met.where("lo <> hi").select("h", "node", "n").distinct())
    sized = lambda x, y: F.least(x, y) >= likeness * F.greatest(x, y) - 1e-9
    links, tried, comp = None, None, shared.withColumn("c", F.col("node"))
    if radius is not None:
        tried = checkpointed(_by_fingerprints(rows, radius))
        links = checkpointed(_verified(tried, named, docs, text_col, likeness, size))
        sweep(docs.sparkSession)
        comp = checkpointed(shared.join(connected_components(links).hint("merge"), "node", "left").select("h", "node", "n", F.coalesce("root", "node").alias("c")))
    for k in range(ROUNDS):
        head = F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("o"), "node", "n", "c")).over(by)
        pairs = comp.withColumn("head", head).where((F.col("c") != F.col("head.c")) & sized(F.col("n"), F.col("head.n")))
        pairs = pairs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
        pairs = checkpointed(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        met = pairs.join(shared.select(F.col("node").alias("a"), F.col("n").alias("na"), "h"), "a").join(shared.select(F.col("node").alias("b"), F.col("n").alias("nb"), "h"), ["b", "h"])
        near = _reachable(met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("same")), likeness)
        near = checkpointed(_verified(checkpointed(near), named, docs, text_col, likeness, size))
        sweep(docs.sparkSession)
        links, tried = (near, pairs) if links is None else (links.unionByName(near), tried.unionByName(pairs))
        found = connected_components(links)
        comp = shared.join(found, "node", "left").select("h", "node", "n", F.coalesce("root", "node").alias("c"))
        comp = checkpointed(comp.withColumn("lo", F.min("c").over(by)).withColumn("hi", F.max("c").over(by)).where("lo <> hi").select("h", "node", "n", "c"))
        if near.isEmpty():
            break
    sketches = rows.where("n > 0").groupBy("node").agg(F.any_value("sketch").alias("s"))
    comp = checkpointed(comp.join(sketches, "node"))
    sweep(docs.sparkSession)
    other = comp.select(F.col("h").alias("h2"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("s").alias("sb"))
    apart = reduce(Column.__add__, [F.bit_count(F.get("s", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH)])
    may = apart <= (1 - likeness) / (1 + likeness) * (F.col("na") + F.col("nb")) + 1e-6
    on = (F.col("h") == F.col("h2")) & (F.col("a") < F.col("b")) & (F.col("c") != F.col("cb")) & sized(F.col("na"), F.col("nb")) & may
    rest = comp.select("h", F.col("node").alias("a"), F.col("n").alias("na"), "c", "s").join(other, on)
    # All shingles that the prefixes of two texts in unlike components share are in comp.
    rest = _reachable(rest.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("same")), likeness)
    rest = checkpointed(rest.join(tried, ["a", "b"], "left_anti"))
    sweep(docs.sparkSession)
    links = links.unionByName(_verified(rest, named, docs, text_col, likeness, size))
    roots = connected_components(links).withColumnRenamed("node", "linked")
    return rows.join(roots, F.col("node") == F.col("linked"), "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
