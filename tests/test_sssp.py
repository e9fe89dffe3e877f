import pytest
from graphs import dijkstra, frame, long_fixture, random_graph, solved
from pyspark.sql import functions as F

from pathloom.functions.hashing import hash_of
from pathloom.operators import sssp, validate
from pathloom.operators.adjacency import Adjacency
from pathloom.plans import planner

OPTIONS = {"frontier": {}, "delta": {"delta": 3}, "delta_stepping": {"delta": 3}, "near_far": {"delta": 3}, "filter": {"delta": 3, "parts": 3}, "topk": {"k": 4}, "multi_topk": {"k": 2, "parts": 3}, "owner": {"owners": 3}}


@pytest.mark.parametrize("strategy", OPTIONS)
def test_random_graph_equals_dijkstra(spark, strategy):
    edges = random_graph(1)
    df = frame(spark, edges)
    got = sssp.solve(df, sssp.sources_frame(df, [0]), strategy, **OPTIONS[strategy])
    assert solved(got) == dijkstra(edges, [(0, 0)])


@pytest.mark.parametrize("source", [0, 2050])
def test_long_fixture_by_owners(spark, source):
    n, edges = long_fixture()
    df = frame(spark, edges)
    got = solved(sssp.solve(df, sssp.sources_frame(df, [source]), "owner", n=n, owners=4))
    assert len(edges) == 5638 and got == dijkstra(edges, [(source, 0)])
    assert (len(got), max(d for d, _ in got.values())) == {0: (2050, 2049), 2050: (1, 0)}[source]


def test_batch_and_seeds(spark):
    edges = random_graph(2)
    df = frame(spark, edges)
    rows = sssp.sssp_batch(df, 40, 3).collect()
    for s in sssp.batch_sources(40, 3):
        assert {r["v"]: (r["dist"], r["hops"]) for r in rows if r["source"] == s} == dijkstra(edges, [(s, 0)])
    seeds = spark.createDataFrame([(0, 0, 4), (0, 25, 0), (0, 0, 9)], "q long, v long, dist long")
    assert solved(sssp.solve(df, seeds)) == dijkstra(edges, [(0, 4), (25, 0)])
    assert sssp.batch_sources(2, 5) == [0, 1, 0, 1, 0]


def test_predecessors_paths_and_certificate(spark):
    edges = random_graph(3)
    df = frame(spark, edges)
    found = sssp.sssp(df, 0, vertices=spark.range(40)).collect()
    want = dijkstra(edges, [(0, 0)])
    for r in found:
        if r["v"] not in want:
            assert r["dist"] is None and r["pred"] is None
            continue
        d, h = want[r["v"]]
        assert (r["dist"], r["hops"]) == (d, h)
        tight = [s for s, t, w in edges if t == r["v"] and s in want and (want[s][0] + w, want[s][1] + 1) == (d, h)]
        assert r["pred"] == (min(tight) if h else None)
    one = sssp.sssp(df, 0)
    paths = sssp.path_to(one, spark.createDataFrame([(v,) for v in (*want, 39)], "v long")).collect()
    pred = {r["v"]: r["pred"] for r in found}
    for t in want:
        walk, v = [], t
        while v is not None:
            walk.append(v)
            v = pred[v]
        assert [r["v"] for r in sorted((r for r in paths if r["target"] == t), key=lambda r: r["step"])] == walk[::-1]
    seeds = sssp.sources_frame(df, [0])
    full = sssp.solve(df, seeds)
    assert tuple(validate.certificate(full, df, seeds).first()) == (0, 0, len(want))
    wrong = full.withColumn("dist", F.when(F.col("v") == max(want), F.col("dist") + 1).otherwise(F.col("dist")))
    assert validate.certificate(wrong, df, seeds).first()["unsupported"] >= 1
    assert validate.first_mismatch(wrong, full).first()["v"] == max(want)
    assert validate.errors_by_query(wrong, full).first()["errors"] == 1


def test_bad_input_raises(spark):
    def one(w, kind="long"):
        return spark.createDataFrame([(0, 0, 1, w)], f"eid long, src long, dst long, weight {kind}")

    for bad in (one(-1), one(None), one(float("nan"), "double"), one(-0.5, "double")):
        with pytest.raises(ValueError):
            sssp.sssp(bad, 0)
    with pytest.raises(ValueError):
        sssp.sssp(one(1), 5, vertices=spark.range(2))
    with pytest.raises(ValueError):
        sssp.sssp(one(1), -1)
    with pytest.raises(ValueError):
        sssp.solve(one(1), sssp.sources_frame(one(1), [0]), "delta")
    with pytest.raises(ValueError):
        sssp.solve(one(1), sssp.sources_frame(one(1), [0]), "other")


def test_large_and_float_distances(spark):
    edges = frame(spark, [(0, 1, 2**31 - 2), (1, 2, 1), (2, 3, 2**40)])
    assert solved(sssp.solve(edges, sssp.sources_frame(edges, [0])))[3][0] == 2**31 - 1 + 2**40
    with pytest.raises(ValueError):
        sssp.sssp(edges, 0, compat_int32=True)
    assert sssp.sssp(edges.where("dst = 1"), 0, compat_int32=True).count() == 2
    half = edges.withColumn("weight", F.lit(0.5))
    assert solved(sssp.solve(half, sssp.sources_frame(half, [0])))[3] == (1.5, 3)


def test_empty_edges_and_star(spark):
    none = frame(spark, [(0, 1, 1)]).where("false")
    for strategy in ("frontier", "owner"):
        assert solved(sssp.solve(none, sssp.sources_frame(none, [0]), strategy)) == {0: (0, 0)}
    star = frame(spark, [(0, i, i) for i in range(1, 3000)])
    assert len(solved(sssp.solve(star, sssp.sources_frame(star, [0]), "owner", owner_edges=100))) == 3000


def test_planner():
    assert [planner.initial_delta(w, 1) for w in (0, 128, 32 * 6, 32 * 5, 32 * 100)] == [4, 4, 8, 4, 128]
    assert planner.adaptive(20, 30, 10, 2).strategy == "delta" and planner.adaptive(5, 1, 10, 2).strategy == "frontier"
    assert planner.adaptive(2, 1, 10, 2) == planner.Choice("near_far", 50)
    assert planner.by_cut(300_000, 1, 10_000) == "delta" and planner.by_cut(100, 1, 10_000) is None and planner.by_cut(300_000, 0, 10) is None
    assert [planner.bucket(d, 0, 10, 4) for d in (0, 9, 10, 99)] == [0, 0, 1, 3] and planner.bag(100, 0, 1) == 31
    assert planner.for_diameter(1000, 2000) == "owner" and planner.for_diameter(4, 2000) == "frontier"


#: Rounds as tables that are merged, as levels in buckets, and as few rows that come and go.
REGIMES = {"merged": {"FEW": 0}, "levels": {"FEW": 0, "WIDE": 0, "LEVELS": 2, "BUCKETED": 10}, "mixed": {"FEW": 6, "MET": 8, "WIDE": 0, "LEVELS": 2, "BUCKETED": 10, "LATE": 5}}


@pytest.mark.parametrize("strategy,regime", [("frontier", "levels"), ("frontier", "mixed"), ("delta_stepping", "levels"), ("delta_stepping", "mixed"), ("multi_topk", "merged")])
def test_regimes_and_hubs(spark, strategy, regime, monkeypatch):
    for name, value in REGIMES[regime].items():
        monkeypatch.setattr(sssp, name, value)
    edges = random_graph(4)
    df = frame(spark, edges)
    got = sssp.solve(df, sssp.sources_frame(df, [0]), strategy, block_edges=5 if regime == "mixed" else 2, **OPTIONS[strategy])
    assert solved(got) == dijkstra(edges, [(0, 0)])


@pytest.mark.parametrize("strategy,regime,cases", [("delta", None, 2), ("delta_stepping", None, 4), ("near_far", None, 2), ("delta", "merged", 1)])
def test_floating_buckets_end(spark, strategy, regime, cases, monkeypatch):
    for name, value in REGIMES.get(regime, {}).items():
        monkeypatch.setattr(sssp, name, value)
    for weight, delta in ((1e17, 1.0), (172.33333333333331, 1 / 3), (0.1, 0.3), (5e-324, 1.0))[:cases]:
        df = spark.createDataFrame([(i, i, i + 1, weight) for i in range(3)], "eid long, src long, dst long, weight double")
        want = [0.0, weight, weight + weight, weight + weight + weight]
        got = sssp.solve(df, sssp.sources_frame(df, [0]), strategy, delta=delta, max_rounds=20)
        assert [r["dist"] for r in got.orderBy("v").collect()] == want


def test_delta_stepping_relaxes_less(spark):
    import random

    r = random.Random(9)
    edges = [(r.randrange(60), r.randrange(60), r.choice([1, 2, 3, 40, 50, 60])) for _ in range(600)]
    df = frame(spark, edges)
    seeds = sssp.sources_frame(df, [0])
    whole, split = {}, {}
    a, b = sssp.solve(df, seeds, "delta", delta=10, counts=whole), sssp.solve(df, seeds, "delta_stepping", delta=10, counts=split)
    assert solved(a) == solved(b) == dijkstra(edges, [(0, 0)])
    reached = {v for v in solved(b)}
    heavy = sum(w > 10 for s, _, w in edges if s in reached)
    assert heavy <= split["relaxed"] < whole["relaxed"]


def test_batches_by_owner_in_blocks_of_queries(spark):
    edges = random_graph(5)
    df = frame(spark, edges)
    for hub in (10**6, 4):
        rows = sssp.sssp_batch(df, 40, 12, "owner", owners=3, query_block=4, owner_edges=hub).collect()
        for s in sssp.batch_sources(40, 12):
            assert {r["v"]: (r["dist"], r["hops"]) for r in rows if r["source"] == s} == dijkstra(edges, [(s, 0)])


def test_narrow_rounds_move_no_edges(spark):
    df = frame(spark, [(i, i + 1, 1) for i in range(200)] + [(500, i, 2) for i in range(900)])
    edges = Adjacency(df, "long", block_edges=64)
    try:
        assert edges.hub_ids == {500} and edges.hubs.first()["blocks"] == 15
        held = edges.stored.frame.where("s = 500").groupBy("k").count().collect()
        assert len(held) == 15 and max(r["count"] for r in held) < 3 * 60
        rows = spark.createDataFrame([(0, 500, 1, 0), (0, 3, 7, 2)], "q long, v long, dist long, hops long")
        assert edges.expand(rows).count() == 901
        assert sorted(tuple(r) for r in edges.of_few([3, 7], 10)) == [(3, 4, 1), (7, 8, 1)] and edges.of_few(list(range(30)), 10) is None
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = edges.expand(rows)._jdf.queryExecution().executedPlan().toString()
        scan = plan.index("Bucketed: true")
        assert "SortMergeJoin" in plan[:scan] and "Exchange" not in plan[plan.rindex("Sort [k#", 0, scan) : scan]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        edges.drop()


def test_hashes_equal_sparks(spark):
    rows = [(0, 0), (5, 1), (-1, 2**62), (2**63 - 1, -(2**63))]
    got = spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b").alias("two"), F.xxhash64("a").alias("one")).collect()
    assert [(r["two"], r["one"]) for r in got] == [(hash_of(a, b), hash_of(a)) for a, b in rows]


def test_rounds_that_do_not_do_raise_and_tables_go(spark):
    from pathlib import Path

    df = frame(spark, [(i, i + 1, 1) for i in range(6)])
    with pytest.raises(RuntimeError, match="still open"):
        sssp.solve(df, sssp.sources_frame(df, [0]), max_rounds=3)
    with pytest.raises(ValueError):
        sssp.solve(df, sssp.sources_frame(df, [0]), "L1V_L2XX")
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    assert len(solved(sssp.solve(df, sssp.sources_frame(df, [0]), "L1FQ_L2DQ", delta=1, bucket_rows=2))) == 7
    assert not [p for p in folder.iterdir() if p.name not in before and p.name.startswith(("level", "open", "edges", "settled"))]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("level", "edges"))]


def test_owners_are_bounded_by_edges_whatever_is_asked(spark, monkeypatch):
    """Asked for two owners, a path of 200 edges gets as many as hold 20 edges each, so no task holds more than about that."""
    held = []
    cut = sssp.partition.edge_balanced
    monkeypatch.setattr(sssp.partition, "edge_balanced", lambda *a: held.append(cut(*a)) or held[-1])
    edges = [(i, i + 1, 1 + i % 3) for i in range(200)] + [(i + 1, i, 1 + i % 4) for i in range(0, 200, 2)]
    df, counts = frame(spark, edges), {}
    monkeypatch.setattr(sssp, "LEVELS", 3)
    got = solved(sssp.solve(df, sssp.sources_frame(df, [0]), "owner", owners=2, owner_edges=20, counts=counts))
    assert got == dijkstra(edges, [(0, 0)])
    assert len(held[0]) - 1 == 15 and max(sum(a <= s < b for s, _, _ in edges) for a, b in zip(held[0], held[0][1:], strict=False)) <= 40
    # A round goes on into the next owner, and offers that are worse open nothing.
    assert counts["rounds"] == 15


def test_owners_keep_floats_and_long_distances_exact(spark):
    df = spark.createDataFrame([(0, 1, 1 / 3), (1, 2, 1 / 7), (0, 2, 0.9), (2, 3, 0.0)], "src long, dst long, weight double")
    got = solved(sssp.solve(df, sssp.sources_frame(df, [0]), "owner", owners=3))
    assert got == {0: (0.0, 0), 1: (1 / 3, 1), 2: (1 / 3 + 1 / 7, 2), 3: (1 / 3 + 1 / 7, 3)}
    far = frame(spark, [(0, 1, 2**53), (1, 2, 1)])
    assert solved(sssp.solve(far, sssp.sources_frame(far, [0]), "owner", owners=2)) == {0: (0, 0), 1: (2**53, 1), 2: (2**53 + 1, 2)}


def test_probe_sees_all_levels_that_matter(spark, monkeypatch):
    """The probe goes on until the rule is decided, and no fixed number of levels ends it."""
    df = frame(spark, [(i, i + 1, 1) for i in range(12)])
    monkeypatch.setattr(planner, "for_diameter", lambda levels, vertices: "owner" if levels > vertices else "frontier")
    assert planner.probed(df, 0, 11) == "owner" and planner.probed(df, 0, 12) == "frontier" and planner.probed(df, 0, 11, most=5) == "frontier"


def test_diameter_rule_has_all_its_graphs(spark, tmp_path):
    from pathloom.plans import registry

    rows = [(s, p, 1.0 + (s + p) % 5) for s in range(3) for p in range(4)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {tuple(r) for r in registry.QUERIES["diameter_rule"](spark, str(tmp_path)).collect()} == {("trade", "frontier"), ("short", "frontier"), ("long", "owner")}


def test_paths_and_predecessors_broadcast_nothing(spark, monkeypatch):
    plans, keep = [], sssp.checkpointed
    monkeypatch.setattr(sssp, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    solved_rows = spark.createDataFrame([(v, v, v - 1 if v else None) for v in range(9)], "v long, hops long, pred long")
    paths = sssp.path_to(solved_rows, spark.createDataFrame([(8,), (5,)], "v long"))
    assert sorted((r["target"], r["step"]) for r in paths.collect()) == [(5, i) for i in range(6)] + [(8, i) for i in range(9)]
    df = frame(spark, [(0, 1, 1), (1, 2, 1)])
    solved_rows = spark.createDataFrame([(0, v, v, v) for v in range(3)], "q long, v long, dist long, hops long")
    plans.append(sssp.predecessors(solved_rows, df, sssp.sources_frame(df, [0]))._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "BroadcastExchange" in p]
