"""What must not grow with a graph: state in a heap, edges that are written again, what the driver is sent."""

import struct

import pytest
from graphs import dijkstra, frame, random_graph

from pyspark.sql.classic.dataframe import DataFrame

from pyspark.sql import functions as F

from pathloom.functions.lineage import Stored
from pathloom.operators import reorder, sssp
from pathloom.operators.adjacency import Adjacency, Layers
from pathloom.sources import gr, mtx
from pathloom.streaming import updates


def test_layers_are_stored_once_and_state_lies_on_disk(spark, tmp_path):
    edges = random_graph(11)
    df = frame(spark, edges)
    for part in range(3):
        df.where(f"eid % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    followed = updates.Followed(spark, sssp.sources_frame(df, [0]))
    followed.start(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination(120)
    assert {r["v"]: r["dist"] for r in followed.distances().collect()} == {v: d for v, (d, _) in dijkstra(edges, [(0, 0)]).items()}
    assert sum(x.stored.about for x in followed.layers.parts) == sum(x.count() for x in followed.kept)
    assert list((tmp_path / "ck" / "state").rglob("*.changelog")) and not list((tmp_path / "ck" / "state").rglob("*.delta"))
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_solve_over_layers(spark):
    edges = random_graph(12)
    df, layers = frame(spark, edges), Layers(spark)
    for part in range(2):
        layers.add(Adjacency(df.where(f"eid % 2 = {part}"), "long", block_edges=4))
    seeds = sssp.sources_frame(df, [0])
    got = {r["v"]: (r["dist"], r["hops"]) for r in sssp.solve(layers, seeds, "delta", delta=3).collect()}
    assert got == dijkstra(edges, [(0, 0)])
    with pytest.raises(ValueError):
        sssp.solve(layers, seeds, "owner")
    layers.drop()


@pytest.mark.parametrize("m", [0, 121])
def test_files_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch, m):
    edges = sorted(random_graph(13, m=m)) if m else []
    df = frame(spark, edges).repartition(5)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    gr.write_gr(df, 40, str(tmp_path / "g.gr"))
    mtx.write_mtx(df, 40, str(tmp_path / "g.mtx"))
    ends = [sum(e[0] <= v for e in edges) for v in range(40)]
    dst, weights = [e[1] for e in edges], [e[2] for e in edges]
    k = len(edges)
    want = struct.pack("<4Q", 1, 4, 40, k) + struct.pack("<40Q", *ends) + struct.pack(f"<{k}I", *dst) + b"\0" * 4 * (k % 2) + struct.pack(f"<{k}i", *weights)
    assert (tmp_path / "g.gr").read_bytes() == want
    assert (tmp_path / "g.mtx").read_text().splitlines() == ["%%MatrixMarket matrix coordinate integer general", f"40 40 {k}", *[f"{s + 1} {d + 1} {w}" for s, d, w in edges]]


def test_a_wide_level_is_many_tasks(spark, monkeypatch):
    """Vertices 1 to 400 below the root, each with three further ones: two levels, of which one has three quarters of the edges."""
    edges = [(0, v, 1) for v in range(1, 401)] + [(v, 400 + 3 * v + k, 1) for v in range(1, 401) for k in range(3)]
    seen = []

    class Watched(Stored):
        def __init__(self, df, purpose="stored", *args, **options):
            super().__init__(df, purpose, *args, **options)
            if purpose == "layers":
                seen.append(self.frame.select("level", F.input_file_name().alias("file")).groupBy("level").agg(F.count_distinct("file").alias("files")).collect())

    monkeypatch.setattr(reorder, "Stored", Watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = reorder.bfs_order(frame(spark, edges), 1603, run_edges=100).orderBy("new_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in got] == [(v, v, 0 if v == 0 else 1 if v < 401 else 2) for v in range(401)] + [(v - 2, v, 2) for v in range(403, 1603)] + [(1601 + i, v, None) for i, v in enumerate((401, 402))]
    assert max(r["files"] for r in seen[0]) > 1


def test_rebuilding_moves_edges_twice_and_ranks_none(spark, monkeypatch):
    """Edges are numbered in their rows and never ranked over all; joins are merged though the mapping is small. Rows that are too long, and mappings that lack or repeat ids, give what they gave."""
    edges = random_graph(14)
    df, n = frame(spark, edges), 40
    mapping = [(n - 1 - v, v) for v in range(n)]

    def want(pairs):
        moved = sorted((a, i, b, w) for i, (s, d, w) in enumerate(edges) for a, x in pairs if x == s for b, y in pairs if y == d)
        return [(k, a, b, w) for k, (a, _, b, w) in enumerate(moved)]

    def got(pairs, **options):
        return [tuple(r) for r in reorder.rebuild(df, spark.createDataFrame(pairs, "new_id long, old_id long"), **options).orderBy("eid").collect()]

    assert got(mapping[3:]) == want(mapping[3:]) and got(mapping[:20]) == want(mapping[:20]) and got(mapping, most=2) == want(mapping)
    same = [(v // 2, v) for v in range(n)]
    assert got(same) == want(same)
    monkeypatch.setattr(reorder, "ordered_rank", None)
    assert got(mapping) == want(mapping)
    far = [(5 * v + 7, v - 3) for v in range(n + 3, -1, -1)]
    assert got(far) == want(far)
    plan = reorder.rebuild(df, spark.createDataFrame(mapping, "new_id long, old_id long"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan and plan.count("Exchange hashpartitioning") == 4


def test_mappings_are_checked_by_degrees_that_were_counted(spark):
    df = frame(spark, random_graph(15))
    mapping = spark.range(40).select((39 - F.col("id")).alias("new_id"), F.col("id").alias("old_id"))
    sizes = reorder.RowSizes(df)
    after = reorder.rebuild(df, mapping, sizes)
    reorder.check_mapping(df, after, mapping, 40, sizes)
    for wrong in (after.where("eid > 0"), after.withColumn("src", (F.col("src") + 1) % 40)):
        for given in (None, sizes):
            with pytest.raises(ValueError):
                reorder.check_mapping(df, wrong, mapping, 40, given)
    empty = df.where("eid < 0")
    assert reorder.RowSizes(empty).top is None and reorder.rebuild(empty, mapping).count() == 0


@pytest.mark.parametrize("hub", [1 << 16, 4])
def test_predecessors_take_the_stored_edges_and_are_found_once(spark, hub):
    """What follows a solve reads its rows and no edges; predecessors of stored edges are those of a table, hubs or not."""
    edges = random_graph(16)
    df = frame(spark, edges)
    found = sssp.sssp(df, 0, block_edges=hub)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    best = dijkstra(edges, [(0, 0)])
    want = {}
    for v, (dist, hops) in best.items():
        near = [s for s, d, w in edges if d == v and s in best and (best[s][0] + w, best[s][1] + 1) == (dist, hops)]
        want[v] = (dist, hops, min(near) if hops else None)
    assert {r["v"]: (r["dist"], r["hops"], r["pred"]) for r in found.collect()} == want
    solved_rows = sssp.solve(df, sssp.sources_frame(df, [0]))
    assert {r["v"]: r["pred"] for r in sssp.predecessors(solved_rows, df, sssp.sources_frame(df, [0])).collect()} == {v: x[2] for v, x in want.items()}
