"""Shortest paths by rounds of join and min-combine.

A round expands the open rows that the strategy chooses along their stored edges (adjacency) and keeps the least (distance, hops) of each (query, vertex). Three ways, by
the size of the frontier; the result is the same:

- A fair share of what is known: it is merged with all of it in one aggregate.
- Less: candidates are compared with what is known of the same vertices, and improvements are written as a level of their own; what is known is the least of all levels.
  Neither edges nor large levels move; they lie in buckets of the key that the join is on.
- Few rows: their edges, and what is known of the heads, are read by key from the buckets that hold them, without a shuffle. Those rows are at hand, a bounded number.

Levels are merged as they add up, and tables that a round has replaced are deleted.

frontier  all open rows
delta     open rows of the least bucket floor(dist / delta); delta may adapt to how much a bucket holds
delta_stepping  the same, along light edges (weight of delta or less) until the bucket has no open row, then once along the heavy edges of all that it settled
near_far  open rows below a threshold, which moves up when none is left
filter    of each of several parts of the ids the open rows of the part's least bucket; what lies beyond waits
topk      the k open rows with the least distance
multi_topk  the k open rows with the least distance of each of several parts of the ids
owner     each owner of a range of ids solves its part to the end; only what crosses between owners takes a round

The least open distance is always chosen, so each round makes progress whatever floating weights round to.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from pathloom.functions.hashing import hash_of
from pathloom.functions.lineage import Stored, checkpointed
from pathloom.operators import partition
from pathloom.operators.adjacency import BLOCK_EDGES, FEW_HUBS, Adjacency, Layers, among, in_order, local_rows
from pathloom.operators.graph import INT_MAX, check
from pathloom.plans import planner

STRATEGIES = ("frontier", "delta", "delta_stepping", "near_far", "filter", "topk", "multi_topk", "owner")
#: Levels that are read side by side before they are merged.
LEVELS = 12
#: A frontier of at least 1 / WIDE of the known rows is merged with them.
WIDE = 16
#: Open rows that are kept at hand, what they may reach in a round, and improved rows before they are written.
FEW, MET, LATE = 1024, 4096, 32_768
#: Rows of a level that lies in buckets.
BUCKETED = 1 << 20
#: Pointers that are followed outside tables.
HELD = 512
#: Whether the optimizer infers what holds for rows.
PROPAGATED = "spark.sql.constraintPropagation.enabled"
#: Open rows, one for each block of edges, that are sent to all edges at once.
NEAR = 1 << 17


def batch_sources(n: int, count: int) -> list[int]:
    """The sources of a batch: spread over the ids, or repeated where there are more than ids."""
    return [k * n // count if count <= n else k % n for k in range(count)]


def sources_frame(edges: DataFrame, sources: list[int]) -> DataFrame:
    """q, v, dist: one query per source."""
    return edges.sparkSession.createDataFrame([(i, s, 0) for i, s in enumerate(sources)], "q long, v long, dist long")


#: More edges than any path has.
FAR = 1 << 62


def _local(bounds: list[int], kind: str):
    """One owner's rows and edges -> its improved rows (closed) and candidates for other owners and for hubs (open). Rows may hold several distances of a vertex, of which the least counts."""
    number = pa.float64() if kind == "double" else pa.int64()
    shape = pa.schema([("q", pa.int64()), ("v", pa.int64()), ("dist", number), ("hops", pa.int64()), ("open", pa.int32())])

    def run(key, rows: pa.Table, edges: pa.Table) -> pa.Table:
        lo, hi = bounds[key[0].as_py()], bounds[key[0].as_py() + 1]
        if not rows.num_rows:
            return shape.empty_table()
        q, v, had_dist, had_hops, is_open = (rows.column(c).to_numpy() for c in ("q", "v", "dist", "hops", "open"))
        # A side without rows may come without types.
        src, dst, weight, away = (edges.column(c).to_numpy().astype(t) if edges.num_rows else np.empty(0, dtype=t) for c, t in (("src", np.int64), ("dst", np.int64), ("weight", number.to_pandas_dtype()), ("away", bool)))
        order = src.argsort(kind="stable")
        src, dst, weight, away = src[order], dst[order], weight[order], away[order]
        beyond = away | (dst < lo) | (dst >= hi)
        # Vertices by their place among the owner's, heads elsewhere from -1 downwards.
        ids, others = np.unique(np.concatenate([src, dst[~beyond], v])), np.unique(dst[beyond])
        heads = np.where(beyond, -1 - others.searchsorted(dst), ids.searchsorted(dst)).tolist() if len(dst) else []
        first, last, costs = src.searchsorted(ids, "left").tolist(), src.searchsorted(ids, "right").tolist(), weight.tolist()
        at, out = ids.searchsorted(v), []
        for one in np.unique(q[is_open == 1]).tolist():
            own = np.flatnonzero(q == one)
            own = own[np.lexsort((had_hops[own], had_dist[own]))[::-1]]  # the least is written last
            dist, hops, done = [math.inf] * len(ids), [FAR] * len(ids), bytearray(len(ids))
            for i, d, h in zip(at[own].tolist(), had_dist[own].tolist(), had_hops[own].tolist(), strict=True):
                dist[i], hops[i] = d, h
            sent_dist, sent_hops = [math.inf] * len(others), [FAR] * len(others)
            heap = [(dist[i], hops[i], i) for i in set(at[own[is_open[own] == 1]].tolist())]
            heapq.heapify(heap)
            while heap:
                d, h, i = heapq.heappop(heap)
                if done[i] or d != dist[i] or h != hops[i]:
                    continue
                done[i] = 1
                h += 1
                for e in range(first[i], last[i]):
                    j, new = heads[e], d + costs[e]
                    if j >= 0:
                        if new < dist[j] or (new == dist[j] and h < hops[j]):
                            dist[j], hops[j] = new, h
                            heapq.heappush(heap, (new, h, j))
                    elif new < sent_dist[-1 - j] or (new == sent_dist[-1 - j] and h < sent_hops[-1 - j]):
                        sent_dist[-1 - j], sent_hops[-1 - j] = new, h
            for places, names, ds, hs, mark in ((np.flatnonzero(np.frombuffer(done, dtype=np.uint8)), ids, dist, hops, 0), (np.array([k for k, h in enumerate(sent_hops) if h != FAR], dtype=np.int64), others, sent_dist, sent_hops, 1)):
                at_places = places.tolist()
                cols = [np.full(len(places), one), names[places], pa.array([ds[k] for k in at_places], number), pa.array([hs[k] for k in at_places], pa.int64()), np.full(len(places), mark, dtype=np.int32)]
                out.append(pa.table([pa.array(c) for c in cols], schema=shape))
        return pa.concat_tables(out) if out else shape.empty_table()

    return run


class _Known:
    """The least (dist, hops) of each (q, v): levels of written tables, and a few rows that are not written yet, of which the least counts.

    Rows carry kk, the hash of (q, v). A large level lies in buckets of kk, so candidates move to it and not the level to them.
    """

    def __init__(self, spark, kind: str):
        self.spark, self.kind = spark, kind
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[Stored] = []
        self.late: dict[tuple[int, int], tuple] = {}
        #: Bits of hops where distance and hops fit one number.
        self.bits = 0

    def _stored(self, rows: DataFrame, about: int, seen: dict | None = None) -> Stored:
        """rows with kk as a level; large ones in buckets of 2 ** 21 rows or so."""
        bucket = ("kk", max(self.buckets, -(-about // (1 << 21)))) if about > BUCKETED else None
        return Stored(rows.withColumn("kk", F.xxhash64("q", "v")), "level", bucket, seen=seen)

    def add(self, level: Stored) -> None:
        self.levels.append(level)
        if len(self.levels) > LEVELS:
            # Merge the newest levels up to one that is much larger than all after it.
            keep, later = len(self.levels), 0
            while keep and self.levels[keep - 1].about <= 4 * later + 1_000_000:
                keep -= 1
                later += self.levels[keep].about
            old, merged = self.levels[keep:], self._stored(_least(self._union(self.levels[keep:]), self.bits), later)
            self.levels = [*self.levels[:keep], merged]
            for x in old:
                x.drop()

    def _union(self, levels: list[Stored]) -> DataFrame:
        frames = [x.frame.select("q", "v", "dist", "hops") for x in levels]
        return reduce(DataFrame.unionByName, frames)

    def written(self) -> None:
        """The late rows become a level."""
        if self.late:
            rows = local_rows(self.spark, [(*k, *x) for k, x in self.late.items()], {"q": "long", "v": "long", "dist": self.kind, "hops": "long"})
            self.late = {}
            self.add(self._stored(rows, 0))

    def better(self, rows: DataFrame) -> DataFrame:
        """Rows of rows(q, v, dist, hops), one of each (q, v), that are less than what is known."""
        self.written()
        large, small = [x for x in self.levels if x.table], [x for x in self.levels if not x.table]
        left = rows.withColumn("kk", F.xxhash64("q", "v"))
        less = F.col("_d").isNull() | (F.struct("dist", "hops") < F.struct("_d", "_h"))
        own = [F.col(f"r.{c}") for c in ("q", "v", "dist", "hops", "kk")]
        for x in large:
            # On the hash alone, by which the level lies; a row of another pair with this hash does not count.
            found = x.frame.select(F.col("kk").alias("_k"), F.col("q").alias("_q"), F.col("v").alias("_v"), F.col("dist").alias("_d"), F.col("hops").alias("_h"))
            same = (F.col("r.kk") == F.col("_k")) & (F.col("r.q") - F.col("_q") == 0) & (F.col("r.v") - F.col("_v") == 0)
            left = left.alias("r").join(found, same, "left").where(less).select(*own)
        if small:
            found = _least(self._union(small), self.bits).select(F.xxhash64("q", "v").alias("_k"), F.col("q").alias("_q"), F.col("v").alias("_v"), F.col("dist").alias("_d"), F.col("hops").alias("_h"))
            left = left.alias("r").join(found, (F.col("r.q") == F.col("_q")) & (F.col("r.v") == F.col("_v")), "left").where(less).select(*own)
        return left.select("q", "v", "dist", "hops")

    def few(self, pairs) -> dict[tuple[int, int], tuple]:
        """What is known of a few (q, v): rows that are not written yet, else those of their buckets."""
        found = {at: self.late[at] for at in pairs if at in self.late}
        keys = [hash_of(*at) for at in pairs if at not in found]
        if keys:
            for r in reduce(DataFrame.unionByName, [x.frame.where(among("kk", keys)).select("q", "v", "dist", "hops") for x in self.levels]).collect():
                at, has = (r["q"], r["v"]), (r["dist"], r["hops"])
                if at in pairs and (at not in found or has < found[at]):
                    found[at] = has
        return found

    @property
    def about(self) -> int:
        return sum(x.about for x in self.levels) + len(self.late)

    def merge(self, rest: DataFrame | None, grown: DataFrame) -> Stored:
        """Replaces all levels by one that takes in grown. Its rows with open other than 0 are what grown improves, and of rest what it doesn't; seen has their number n and least distance."""
        self.written()
        rows = self._union(self.levels).withColumn("open", F.lit(0)).unionByName(grown.withColumn("open", F.lit(1)))
        # What waits is known with the same values; it wins over the closed row.
        rows = rows if rest is None else rows.unionByName(rest.withColumn("open", F.lit(-1)))
        seen = {"n": F.count_if(F.col("open") != 0), "least": F.min(F.when(F.col("open") != 0, F.col("dist")))}
        old, merged = self.levels, self._stored(_merge(rows, self.bits), self.about, seen)
        self.levels = [merged]
        for x in old:
            x.drop()
        return merged

    def result(self) -> DataFrame:
        self.written()
        return checkpointed(_least(self._union(self.levels), self.bits))

    def drop(self) -> None:
        for x in self.levels:
            x.drop()
        self.levels = []


def _bits(kind: str, top: float, hops: int) -> int:
    """How many bits hops of at most that many take where a distance up to top and two further bits fit the number with them, else 0."""
    bits = max(1, hops.bit_length())
    return bits if kind == "long" and top < 1 << (61 - bits) else 0


def _least(rows: DataFrame, bits: int = 0, *more: str) -> DataFrame:
    """The least (dist, hops) of each (q, v, *more). Rows are sorted for a least struct and hashed for a least number, so with bits both are one number."""
    keys = ["q", "v", *more]
    if not bits:
        return rows.groupBy(*keys).agg(F.min(F.struct("dist", "hops")).alias("m")).select("q", "v", "m.*", *more)
    m = F.col("m")
    least = rows.groupBy(*keys).agg(F.min(F.shiftleft("dist", bits) + F.col("hops")).alias("m"))
    return least.select("q", "v", F.shiftright(m, bits).alias("dist"), m.bitwiseAND(F.lit((1 << bits) - 1)).alias("hops"), *more)


@dataclass(frozen=True)
class _Choice:
    """Which open rows a round expands: those below a bound or at the least distance, so some always; with parts, those up to a bound of each part, or below
    a bound or at the least distance of each part."""

    least: float
    below: float | None = None
    upto: tuple[tuple[int, float], ...] = ()
    parts: int = 1
    # (part, least distance, bound)
    within: tuple[tuple[int, float, float], ...] = ()

    def column(self):
        if self.within:
            part = F.pmod("v", F.lit(self.parts))
            return reduce(lambda x, y: x | y, [(part == p) & ((F.col("dist") < F.lit(b)) | (F.col("dist") <= F.lit(d))) for p, d, b in self.within])
        if self.upto:
            part = F.pmod("v", F.lit(self.parts))
            return reduce(lambda x, y: x | y, [(part == p) & (F.col("dist") <= F.lit(d)) for p, d in self.upto])
        return F.lit(True) if self.below is None else (F.col("dist") < F.lit(self.below)) | (F.col("dist") <= F.lit(self.least))

    def holds(self, v: int, dist: float) -> bool:
        if self.within:
            return any(v % self.parts == p and (dist < b or dist <= d) for p, d, b in self.within)
        if self.upto:
            return any(v % self.parts == p and dist <= d for p, d in self.upto)
        return self.below is None or dist < self.below or dist <= self.least


class _Rounds:
    """Rounds of one solve. Open rows are a table, or while they are few rows at hand; rows are known in _Known either way."""

    def __init__(self, adjacency: Adjacency, start: DataFrame, kind: str, strategy: str, delta: float | None, k: int, parts: int, bucket_rows: int | None, counts: dict | None):
        self.edges, self.kind, self.strategy, self.delta, self.k, self.parts, self.bucket_rows = adjacency, kind, strategy, delta, k, parts, bucket_rows
        self.watched, self.counts = counts is not None, {} if counts is None else counts
        self.spark, self.base = adjacency.spark, 0
        self.known = _Known(self.spark, kind)
        self.counts |= {"rounds": 0, "relaxed": 0}
        # So many rows are few: what they reach should be so as well.
        self.few = min(FEW, int(MET / max(1.0, adjacency.mean_degree)))
        self.opened: Stored | None = None  # a table of open rows that is no level
        # Of the bucket under way: its rows that were expanded along light edges.
        self.settled_rows: dict[tuple[int, int], tuple] = {}
        self.settled: list[Stored] = []
        self.ends: float | None = None
        first = Stored(start.withColumn("kk", F.xxhash64("q", "v")), "level", seen={"least": F.min("dist"), "top": F.max("dist")})
        self.top = first.seen["top"] or 0
        self.known.add(first)
        self.table, self.n, self.least, self.rows = first.frame.drop("kk"), first.about, first.seen["least"], None

    def gather(self) -> None:
        """Few open rows come to hand, unless one is a hub."""
        if self.rows is not None or self.n > self.few or self.edges.hub_ids is None:
            return
        got = self.table.select("q", "v", "dist", "hops").limit(self.few + 1).collect()
        if len(got) <= self.few and not any(r["v"] in self.edges.hub_ids for r in got):
            self.rows = {(r["q"], r["v"]): (r["dist"], r["hops"]) for r in got}
            self.n = len(self.rows)
            self.forget()

    def spill(self) -> None:
        """Rows at hand become a table."""
        if self.rows is not None:
            self.replace(Stored(self._frame(self.rows), "open"))
            self.rows = None

    def _frame(self, rows: dict) -> DataFrame:
        return local_rows(self.spark, [(*at, *x) for at, x in rows.items()], {"q": "long", "v": "long", "dist": self.kind, "hops": "long"})

    def replace(self, table: Stored) -> None:
        before, self.opened, self.table = self.opened, table, table.frame
        if before:
            before.drop()

    def forget(self) -> None:
        if self.opened:
            self.opened.drop()
        self.opened = None

    def choose(self) -> _Choice:
        """By the strategy; self.least is the least open distance."""
        least, dists = self.least, None if self.rows is None else [(at[1], x[0]) for at, x in self.rows.items()]
        if self.strategy in ("delta", "delta_stepping"):
            if self.strategy == "delta_stepping" and self.ends is not None:
                return _Choice(min(least, self.ends), self.ends)
            return _Choice(least, (least // self.delta + 1) * self.delta)
        if self.strategy == "near_far":
            self.base = least if least >= self.base + self.delta else self.base
            return _Choice(least, self.base + self.delta)
        if self.strategy == "filter":
            # A number per part.
            if dists is None:
                first = {r["p"]: r["d"] for r in self.table.groupBy(F.pmod("v", F.lit(self.parts)).alias("p")).agg(F.min("dist").alias("d")).collect()}
            else:
                first = {}
                for v, d in dists:
                    first[v % self.parts] = min(d, first.get(v % self.parts, d))
            return _Choice(least, parts=self.parts, within=tuple((p, d, (d // self.delta + 1) * self.delta) for p, d in sorted(first.items())))
        if self.strategy == "topk":
            if dists is not None:
                return _Choice(least, upto=((0, sorted(d for _, d in dists)[: self.k][-1]),))
            return _Choice(least, upto=((0, self.table.orderBy("dist").limit(self.k).agg(F.max("dist").alias("d")).first()["d"]),))
        if self.strategy == "multi_topk":
            if dists is not None:
                own = [(p, sorted(d for v, d in dists if v % self.parts == p)[: self.k]) for p in range(self.parts)]
                return _Choice(least, upto=tuple((p, x[-1]) for p, x in own if x), parts=self.parts)
            # A number per part: the distance of its k-th row.
            nth = F.row_number().over(Window.partitionBy("p").orderBy("dist"))
            tops = self.table.select(F.pmod("v", F.lit(self.parts)).alias("p"), "dist").withColumn("r", nth).where(F.col("r") <= self.k).groupBy("p").agg(F.max("dist").alias("d")).collect()
            return _Choice(least, upto=tuple((r["p"], r["d"]) for r in tops), parts=self.parts)
        return _Choice(least)

    def adapt(self, held: int) -> None:
        if self.bucket_rows:
            self.delta = self.delta * 2 if held * 4 < self.bucket_rows else max(1, self.delta / 2) if held > 4 * self.bucket_rows else self.delta

    def by_hand(self, chosen: dict, heavy: bool | None) -> bool:
        """A round of few rows: their edges and what is known of the heads are read by key. False, and nothing has changed, if that is too much or reaches a hub."""
        edges = self.edges.of_few(sorted({v for _, v in chosen}), MET, heavy)
        if edges is None:
            return False
        heads, offered, relaxed = defaultdict(list), {}, 0
        for e in edges:
            heads[e["s"]].append((e["t"], e["w"]))
        for (q, v), (dist, hops) in chosen.items():
            relaxed += len(heads[v])
            if relaxed > MET:
                return False
            for t, w in heads[v]:
                new = (dist + w, hops + 1)
                if (q, t) not in offered or new < offered[q, t]:
                    offered[q, t] = new
        if any(t in self.edges.hub_ids for _, t in offered):
            return False
        self.counts["relaxed"] += relaxed
        for at in chosen if heavy is not True else ():
            del self.rows[at]
        have = self.known.few(offered)
        for at, new in offered.items():
            if at not in have or new < have[at]:
                self.known.late[at] = self.rows[at] = new
        if len(self.known.late) > LATE:
            self.known.written()
        self.n, self.least = len(self.rows), min((x[0] for x in self.rows.values()), default=None)
        return True

    def by_tables(self, expanded: DataFrame, rest: DataFrame | None, heavy: bool | None) -> None:
        """A round of a table's rows: expanded along their edges; rest stays open."""
        grown = self.edges.expand(expanded, heavy, near=self.n * self.edges.most_blocks <= NEAR)
        if self.watched:
            watch = Observation()
            grown = grown.observe(watch, F.count(F.lit(1)).alias("n"))
        if self.n * WIDE >= self.known.about:
            merged = self.known.merge(rest, grown)
            self.forget()
            self.table, self.n, self.least = merged.frame.where("open <> 0").select("q", "v", "dist", "hops"), merged.seen["n"], merged.seen["least"]
        else:
            fresh = self.known._stored(self.known.better(_least(grown, self.known.bits)), self.n, {"least": F.min("dist")})
            if rest is None:
                # A level may be merged away while it is still the frontier: that is read first.
                if len(self.known.levels) >= LEVELS:
                    self.replace(Stored(fresh.frame.select("q", "v", "dist", "hops"), "open"))
                else:
                    self.forget()
                    self.table = fresh.frame.select("q", "v", "dist", "hops")
                self.n, self.least = fresh.about, fresh.seen["least"]
            else:
                new = fresh.frame.select("q", "v", "dist", "hops")
                left = rest.join(new.select("q", "v"), ["q", "v"], "left_anti")
                opened = Stored(left.unionByName(new), "open", seen={"least": F.min("dist")})
                self.replace(opened)
                self.n, self.least = opened.about, opened.seen["least"]
            self.known.add(fresh)
        if self.watched:
            self.counts["relaxed"] += watch.get["n"]

    def step(self) -> None:
        """One round: the chosen rows along their edges; with light and heavy edges, along light ones until the bucket has no open row, then what it settled along heavy ones."""
        # A round adds one edge to a path.
        rounds = self.counts["rounds"] + 1
        self.known.bits = _bits(self.kind, self.top + rounds * self.edges.top_weight, rounds)
        self.gather()
        split = self.strategy == "delta_stepping"
        if split and self.ends is not None and (self.n == 0 or self.least >= self.ends):
            return self._heavy()
        choice = self.choose()
        if split:
            self.ends = max(choice.below, math.nextafter(self.least, math.inf)) if self.ends is None else self.ends
        light = False if split else None
        if self.rows is not None:
            chosen = {at: x for at, x in self.rows.items() if choice.holds(at[1], x[0])}
            if self.by_hand(chosen, light):
                self.adapt(len(chosen))
                if split:
                    self.settled_rows.update(chosen)
                return None
            self.few = min(self.few, len(chosen) // 2)
            self.spill()
        picked = choice.column()
        rest = None if self.strategy == "frontier" else self.table.where(~picked)
        expanded = self.table.where(picked)
        if split:
            self.settled.append(Stored(expanded, "settled"))
            expanded = self.settled[-1].frame
        if self.bucket_rows:
            self.adapt(expanded.count())
        return self.by_tables(expanded, rest, light)

    def _heavy(self) -> None:
        """What the bucket settled, along heavy edges, each row once at its last distance."""
        tables, rows, self.ends = self.settled, self.settled_rows, None
        self.settled, self.settled_rows = [], {}
        if not tables and self.rows is not None and self.by_hand(rows, True):
            return
        self.spill()
        frames = [x.frame for x in tables] + ([self._frame(rows)] if rows else [])
        self.by_tables(_least(reduce(DataFrame.unionByName, frames), self.known.bits), self.table, True)
        for x in tables:
            x.drop()

    def run(self, max_rounds: int | None) -> DataFrame:
        try:
            return self._run(max_rounds)
        finally:
            self.known.drop()
            self.forget()
            for x in self.settled:
                x.drop()

    def _run(self, max_rounds: int | None) -> DataFrame:
        with in_order(self.spark):
            while self.n or self.ends is not None:
                if self.counts["rounds"] == max_rounds:
                    raise RuntimeError(f"{self.n} vertices are still open after {max_rounds} rounds")
                self.step()
                self.counts["rounds"] += 1
            return self.known.result()


def solve(edges: DataFrame | Layers, seeds: DataFrame, strategy: str = "frontier", delta: float | None = None, k: int = 10_000, n: int | None = None, owners: int | None = None, owner_edges: int = 1_000_000, max_rounds: int | None = None, parts: int = 8, bucket_rows: int | None = None, block_edges: int = BLOCK_EDGES, query_block: int = 8, counts: dict | None = None) -> DataFrame:
    """q, v, dist, hops for every vertex that a query's seeds reach.

    seeds(q, v, dist): where queries start and at what distance; rows with the same q are one query. Weights must be
    non-negative; null or NaN weights and null ends raise ValueError. hops is the least number of edges among the shortest paths.
    strategy may be a queue's name (planner.QUEUES). Rounds beyond max_rounds raise RuntimeError. With bucket_rows, delta doubles after a bucket with less than a
    quarter as many rows and halves after one with more than four times as many. multi_topk and filter choose of each of `parts` parts.
    Edges of a vertex with more than block_edges of them are dealt over several blocks. counts, if given, gets the rounds and the relaxed edges (a lost executor may count some twice).
    `owner` needs ids 0..n-1 (n defaults to the largest id + 1). A task holds at most about owner_edges edges and, for about query_block queries, their
    vertices; the edges of a vertex with more than that are joined to it outside the owners' tasks.
    edges may be stored adjacency, which is not dropped; `owner` and `delta_stepping` store edges in their own way and refuse it.
    """
    strategy = planner.QUEUES.get(strategy, strategy)
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}, or a queue's name")
    held = isinstance(edges, Layers)
    if held and strategy in ("owner", "delta_stepping"):
        raise ValueError(f"{strategy} takes a table of edges")
    kind = edges.kind if held else dict(edges.dtypes)["weight"]
    kind = "double" if kind in ("double", "float") else "long"
    if seeds.where(F.col("v").isNull() | F.col("dist").isNull() | (F.col("dist") < 0)).limit(1).collect():
        raise ValueError("seeds need a vertex and a non-negative distance")
    start = _least(seeds.select(F.col("q").cast("long").alias("q"), F.col("v").cast("long").alias("v"), F.col("dist").cast(kind).alias("dist"), F.lit(0).cast("long").alias("hops")))
    if strategy == "owner":
        return _by_owner(edges, start, kind, n, owners, owner_edges, query_block, max_rounds, {} if counts is None else counts)
    if strategy in ("delta", "delta_stepping", "near_far", "filter") and not (delta and delta > 0):
        raise ValueError(f"{strategy} needs a delta above 0")
    adjacency = edges if held else Adjacency(edges, kind, block_edges, delta if strategy == "delta_stepping" else None)
    try:
        return _Rounds(adjacency, start, kind, strategy, delta, k, parts, bucket_rows, counts).run(max_rounds)
    finally:
        if not held:
            adjacency.drop()


class _Settled:
    """What owners have settled: tables of (q, v, dist, hops, open, owner), of whose rows the closed ones count and of these the least. Rows lie by owner, so few owners' rows are few files."""

    def __init__(self):
        self.levels: list[Stored] = []

    def tidy(self) -> None:
        if len(self.levels) > LEVELS:
            # Merge the newest levels up to one that is much larger than all after it.
            keep, later = len(self.levels), 0
            while keep and self.levels[keep - 1].about <= 4 * later + 1_000_000:
                keep -= 1
                later += self.levels[keep].about
            old = self.levels[keep:]
            rows = _closed(old).groupBy("owner", "q", "v").agg(F.min(F.struct("dist", "hops")).alias("m")).select("q", "v", "m.*", F.lit(0).alias("open"), "owner")
            self.levels = [*self.levels[:keep], Stored(rows.repartitionByRange("owner", "v").sortWithinPartitions("owner"), "owned")]
            for x in old:
                x.drop()

    def of(self, owners: list[int]) -> DataFrame:
        """q, v, dist, hops, open, owner of some owners."""
        return _closed(self.levels).where(F.col("owner").isin(owners))

    def result(self) -> DataFrame:
        return checkpointed(_least(_closed(self.levels)))

    def drop(self) -> None:
        for x in self.levels:
            x.drop()


def _closed(levels: list[Stored]) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.frame.where("open = 0").select("q", "v", "dist", "hops", "open", "owner") for x in levels])


def _by_owner(edges: DataFrame, start: DataFrame, kind: str, n: int | None, owners: int | None, owner_edges: int, query_block: int, max_rounds: int | None, counts: dict) -> DataFrame:
    """Rounds of local solves. A task has one owner's edges and what is known there of a block of queries. Vertices with more than owner_edges edges are hubs: they are
    nobody's, and their edges are joined to them block by block. A round reads the edges and rows of the owners that have open rows, and writes what it improves."""
    spark, settled = edges.sparkSession, _Settled()
    plain = edges.select("src", "dst", F.col("weight").cast(kind).alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)
    owned = opened = hub_edges = None
    try:
        check(plain)
        size = plain.agg(F.count(F.lit(1)).alias("m"), F.max(F.greatest("src", "dst")).alias("top")).first()
        asked = start.agg(F.max("v").alias("top"), F.count_distinct("q").alias("queries")).first()
        n = max(x for x in (size["top"], asked["top"], 0) if x is not None) + 1 if n is None else n
        hubs = checkpointed(plain.groupBy(F.col("src").alias("hub")).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > owner_edges).select("hub"))
        hub_count = hubs.count()
        near = F.broadcast(hubs) if hub_count <= FEW_HUBS else hubs
        rest = plain.join(near, F.col("src") == F.col("hub"), "left_anti") if hub_count else plain
        if hub_count:
            hub_edges = Adjacency(plain.join(near, F.col("src") == F.col("hub"), "left_semi"), kind, min(owner_edges, BLOCK_EDGES))
        # As many owners as the edges need, however few were asked for.
        bounds = partition.edge_balanced(rest, n, min(max(owners or 1, -(-size["m"] // owner_edges)), n))
        blocks = max(1, -(-asked["queries"] // query_block))
        met = rest.join(near, F.col("dst") == F.col("hub"), "left").withColumn("away", F.col("hub").isNotNull()).drop("hub") if hub_count else rest.withColumn("away", F.lit(False))
        # In buckets of the owner: a round reads the buckets of its owners.
        owned = Stored(met.withColumn("owner", partition.owner(F.col("src"), bounds)), "cut", ("owner", len(bounds) - 1))
        plain.unpersist()
        keys = ["owner", "block"] if blocks > 1 else ["owner"]

        def placed(rows: DataFrame) -> DataFrame:
            """Rows with their vertex's owner, -1 for hubs."""
            own = partition.owner(F.col("v"), bounds)
            if not hub_count:
                return rows.withColumn("owner", own)
            return rows.join(near, F.col("v") == F.col("hub"), "left").withColumn("owner", F.when(F.col("hub").isNotNull(), -1).otherwise(own)).drop("hub")

        in_blocks = lambda rows: rows.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
        opened = Stored(placed(start), "owned")
        counts["rounds"] = 0
        while True:
            # At most one row for each owner and block.
            active = [tuple(r) for r in in_blocks(opened.frame).select("owner", "block").distinct().collect()]
            if not active:
                break
            if counts["rounds"] == max_rounds:
                raise RuntimeError(f"vertices are still open after {max_rounds} rounds")
            took, found = sorted({o for o, _ in active if o >= 0}), []
            if took:
                rows = opened.frame.where("owner >= 0").select("q", "v", "dist", "hops", F.lit(1).alias("open"), "owner")
                rows = in_blocks(rows.unionByName(settled.of(took)) if settled.levels else rows)
                own = owned.frame.where(F.col("owner").isin(took))
                if blocks > 1:
                    at = F.broadcast(spark.createDataFrame(active, "owner int, block int"))
                    rows, own = rows.join(at, keys, "left_semi"), own.join(at, "owner")
                found.append(rows.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(_local(bounds, kind), f"q long, v long, dist {kind}, hops long, open int"))
            if len(took) < len({o for o, _ in active}):
                spokes = opened.frame.where("owner < 0").select("q", "v", "dist", "hops")
                found += [spokes.withColumn("open", F.lit(0)), hub_edges.expand(spokes).withColumn("open", F.lit(1))]
            done = Stored(placed(reduce(DataFrame.unionByName, found)), "owned", seen={"offers": F.count_if(F.col("open") == 1)})
            settled.levels.append(done)
            counts["rounds"] += 1
            before, offers = opened, done.frame.where("open = 1")
            opened = None
            before.drop()
            if not done.seen["offers"]:
                break
            # Of what is offered elsewhere, what is less than is known there.
            best = offers.groupBy("q", "v", "owner").agg(F.min(F.struct("dist", "hops")).alias("m")).select("q", "v", "m.*", "owner")
            known = _least(settled.of([r["owner"] for r in offers.select("owner").distinct().collect()]))
            known = known.select(F.col("q").alias("_q"), F.col("v").alias("_v"), F.struct("dist", "hops").alias("_has")).hint("merge")
            left = best.join(known, (F.col("q") == F.col("_q")) & (F.col("v") == F.col("_v")), "left").where(F.col("_has").isNull() | (F.struct("dist", "hops") < F.col("_has")))
            opened = Stored(left.select("q", "v", "dist", "hops", "owner"), "owned")
            settled.tidy()
        return settled.result() if settled.levels else checkpointed(start)
    finally:
        settled.drop()
        for x in (opened, hub_edges, owned):
            if x:
                x.drop()
        plain.unpersist()


def _merge(rows: DataFrame, bits: int = 0) -> DataFrame:
    """Of equal distances and hops a closed row wins, so only improvements stay open."""
    if bits:
        m = F.col("m")
        least = rows.groupBy("q", "v").agg(F.min(F.shiftleft(F.shiftleft("dist", bits) + F.col("hops"), 2) + F.col("open") + 1).alias("m"))
        return least.select("q", "v", F.shiftright(m, bits + 2).alias("dist"), F.shiftright(m, 2).bitwiseAND(F.lit((1 << bits) - 1)).alias("hops"), (m.bitwiseAND(F.lit(3)) - 1).cast("int").alias("open"))
    return rows.groupBy("q", "v").agg(F.min(F.struct("dist", "hops", "open")).alias("m")).select("q", "v", "m.*")


def predecessors(solved: DataFrame, edges: DataFrame | Layers, seeds: DataFrame) -> DataFrame:
    """solved with pred: the least vertex before v on a shortest path of the fewest hops; null for seeds that are their own start. Stored edges don't move."""
    if isinstance(edges, Layers):
        offers = edges.expand(solved.select("q", "v", "dist", "hops"), tail="u")
    else:
        before = solved.select("q", F.col("v").alias("u"), F.col("dist").alias("du"), F.col("hops").alias("hu"))
        offers = before.join(edges.hint("merge"), F.col("u") == F.col("src")).select("q", F.col("dst").alias("v"), (F.col("du") + F.col("weight")).alias("dist"), (F.col("hu") + 1).alias("hops"), "u")
    # Equal offers are few rows before they are sorted for the join.
    best = offers.groupBy("q", "v", "dist", "hops").agg(F.min("u").alias("pred"))
    return solved.join(best.hint("merge"), ["q", "v", "dist", "hops"], "left").select("q", "v", "dist", "hops", F.when(F.col("hops") > 0, F.col("pred")).alias("pred"))


def sssp(edges: DataFrame, source: int, vertices: DataFrame | None = None, strategy: str = "frontier", compat_int32: bool = False, **options) -> DataFrame:
    """v, dist, hops, pred from one source. With vertices, one row for each, null where it isn't reached. Edges are stored once for distances and predecessors, and the result is written, so what follows reads no edges.

    Raises ValueError if the source isn't in vertices (or, without vertices, negative), and with compat_int32 if a distance reaches INT_MAX.
    """
    known = vertices is None and source >= 0 or vertices is not None and vertices.where(F.col("id") == source).limit(1).count() == 1
    if not known:
        raise ValueError(f"source {source} is not a vertex")
    seeds, name, stored = sources_frame(edges, [source]), planner.QUEUES.get(strategy, strategy), edges
    if name in STRATEGIES and name not in ("owner", "delta_stepping"):
        stored = Layers(edges.sparkSession)
        stored.add(Adjacency(edges, "double" if dict(edges.dtypes)["weight"] in ("double", "float") else "long", options.pop("block_edges", BLOCK_EDGES)))
    try:
        solved = solve(stored, seeds, strategy, **options)
        if compat_int32 and solved.where(F.col("dist") >= INT_MAX).limit(1).count():
            raise ValueError("a distance does not fit 32 bits")
        found = checkpointed(predecessors(solved, stored, seeds).drop("q"))
    finally:
        if stored is not edges:
            stored.drop()
    return found if vertices is None else vertices.select(F.col("id").alias("v")).join(found, "v", "left")


def sssp_batch(edges: DataFrame, n: int, count: int, strategy: str = "frontier", **options) -> DataFrame:
    """source, v, dist, hops: a full query for each of batch_sources(n, count), all in the same rounds. Not the nearest source."""
    picked = batch_sources(n, count)
    seeds = sources_frame(edges, picked)
    solved = solve(edges, seeds, strategy, **options)
    return solved.join(F.broadcast(seeds.select("q", F.col("v").alias("source"))), "q").select("q", "source", "v", "dist", "hops")


def bfs_levels(edges: DataFrame, root: int) -> DataFrame:
    """v, level."""
    solved = solve(edges.withColumn("weight", F.lit(1).cast("long")), sources_frame(edges, [root]))
    return solved.select("v", F.col("dist").alias("level"))


def path_to(solved: DataFrame, targets: DataFrame) -> DataFrame:
    """target, step, v: for every target (one column v) the path from its seed along pred.

    solved(v, hops, pred) is one query. A target that isn't reached gives no rows. Pointers over 2, 4, 8, ... steps are made only for vertices whose hops they divide, so
    all of them together are no more rows than there are vertices. A target goes down by the bits of its hops, which leaves gaps of
    such lengths; gaps are then halved until they are single steps. Rounds are as many as twice the bits of the longest path, less those in which at most HELD pointers are left.
    Pointers and ways grow with the graph and compress well, so a few MB of them in a shuffle are many in a driver: they are merged, never broadcast.
    """
    spark = solved.sparkSession
    had = spark.conf.get(PROPAGATED, None)
    # Checkpoints keep what is known of their rows, which doubles with each step that unites and joins them: minutes of planning.
    spark.conf.set(PROPAGATED, "false")
    try:
        return _paths(solved, targets)
    finally:
        spark.conf.set(PROPAGATED, had) if had is not None else spark.conf.unset(PROPAGATED)


def _ways(rows: list) -> list[tuple[int, int, int]]:
    """(v, a, hops of a) of all vertices that pointers (v, hops, up) lead to, step by step."""
    up, hops = {r["v"]: r["up"] for r in rows}, {r["v"]: r["hops"] for r in rows}
    step, out = min(hops.values(), default=0), []
    for v in up:
        a, k = v, 0
        while a in up:
            a, k = up[a], k + 1
            out.append((v, a, hops[v] - k * step))
    return out


def _paths(solved: DataFrame, targets: DataFrame) -> DataFrame:
    near = solved.select("v", "hops", F.col("pred").alias("up"))
    front = checkpointed(targets.select(F.col("v").alias("target")).distinct().join(near.hint("merge"), F.col("target") == F.col("v")).select("target", "v", "hops"))
    most = front.agg(F.max("hops")).first()[0] or 0
    jump, jumps, gaps, size = near.where((F.col("hops") > 0) & (F.col("hops") <= most)), [], [], 1
    passed = [front]
    while size <= most:
        if size > 2:
            # A bounded number of pointers is followed to the end at once.
            few = jump.limit(HELD + 1).collect()
            if len(few) <= HELD:
                ways = local_rows(solved.sparkSession, _ways(few), {"v": "long", "a": "long", "h": "long"})
                ends = checkpointed(front.join(ways.hint("merge"), "v").select("target", F.col("a").alias("v"), F.col("h").alias("hops")))
                passed.append(ends)
                gaps.append(checkpointed(front.unionByName(ends).where("hops > 0")))
                break
        jumps.append(jump)
        odd = front.where(F.col("hops").bitwiseAND(F.lit(size)) != 0)
        moved = checkpointed(odd.join(jump.select("v", "up").hint("merge"), "v").select("target", F.col("up").alias("v"), (F.col("hops") - size).alias("hops")))
        gaps.append(odd)
        passed.append(moved)
        front = checkpointed(front.where(F.col("hops").bitwiseAND(F.lit(size)) == 0).unionByName(moved))
        even = jump.where(F.col("hops") % (2 * size) == 0)
        jump = checkpointed(even.join(jump.select(F.col("v").alias("m"), F.col("up").alias("up2")).hint("merge"), F.col("up") == F.col("m")).select("v", "hops", F.col("up2").alias("up")))
        size *= 2
    inner = None
    # gaps[i] are 2 ** i steps long, jumps[i] go over as many.
    for i in range(len(gaps) - 1, 0, -1):
        open_gaps = gaps[i] if inner is None else gaps[i].unionByName(inner)
        middle = checkpointed(open_gaps.join(jumps[i - 1].select("v", "up").hint("merge"), "v").select("target", F.col("up").alias("v"), (F.col("hops") - (1 << (i - 1))).alias("hops")))
        passed.append(middle)
        inner = checkpointed(open_gaps.unionByName(middle)) if i > 1 else None
    return reduce(DataFrame.unionByName, passed).select("target", F.col("hops").alias("step"), "v").distinct()
