"""What a round costs: no sort of offers or of stored edges, no edge found twice."""

import pytest
from graphs import dijkstra, frame, random_graph, solved

from pathloom.functions.lineage import Stored
from pathloom.operators import sssp, validate
from pathloom.operators.adjacency import IN_ORDER, Adjacency, Layers, among, in_order
from pathloom.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_offers_are_hashed_and_stored_edges_not_sorted(spark, monkeypatch):
    seen, keep = [], Stored.__init__
    monkeypatch.setattr(Stored, "__init__", lambda self, df, *a, **o: seen.append((spark.conf.get(IN_ORDER), plan(df))) or keep(self, df, *a, **o))
    monkeypatch.setattr(sssp, "FEW", 0)
    edges = random_graph(21)
    df = frame(spark, edges)
    assert solved(sssp.solve(df, sssp.sources_frame(df, [0]))) == dijkstra(edges, [(0, 0)])
    rounds = [p for on, p in seen if "Scan parquet spark_catalog.default.edges" in p]
    assert rounds and not [p for p in rounds if "SortAggregate" in p or "SortMergeJoin" in p]
    assert spark.conf.get(IN_ORDER) == "false"
    adjacency, rows = Adjacency(df, "long"), spark.createDataFrame([(0, 3, 7, 2)], "q long, v long, dist long, hops long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = plan(adjacency.expand(rows)).count("Sort [")
        with in_order(spark):
            assert plan(adjacency.expand(rows)).count("Sort [") == before - 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        adjacency.drop()


@pytest.mark.parametrize("weight", [1, 2**55, 2**61])
def test_one_number_holds_distance_and_hops_or_none_does(spark, weight):
    """Distances that leave no room for hops are compared as pairs."""
    df = frame(spark, [(0, 1, weight), (1, 2, 0), (0, 2, weight), (2, 3, 1)])
    for strategy in ("frontier", "owner"):
        assert solved(sssp.solve(df, sssp.sources_frame(df, [0]), strategy)) == {0: (0, 0), 1: (weight, 1), 2: (weight, 1), 3: (weight + 1, 2)}
    assert sssp._bits("long", 2**55, 3) == 2 and not sssp._bits("long", 2**60, 3) and not sssp._bits("double", 1.0, 3)


def test_keys_are_found_by_one_expression(spark):
    keys = [-(2**63), -1, 0, 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in [*keys, 5]], "k long")
    assert sorted(r["k"] for r in df.where(among("k", keys)).collect()) == keys and df.where(among("k", [])).count() == 0


@pytest.mark.parametrize("hub", [1 << 16, 4])
def test_certificates_of_stored_edges(spark, hub):
    edges = random_graph(22)
    df, stored = frame(spark, edges), Layers(spark)
    stored.add(Adjacency(df, "long", hub))
    seeds = sssp.sources_frame(df, [0])
    found = sssp.solve(stored, seeds)
    top = max(r["v"] for r in found.collect())
    for rows in (found, found.where(f"v <> {top}"), found.selectExpr("q", "v", f"dist + CAST(v = {top} AS LONG) AS dist", "hops"), found.selectExpr("q", "v", "dist", "hops + 1 AS hops")):
        has = {r["v"]: (r["dist"], r["hops"]) for r in rows.collect()}
        loose = sum(s in has and (d not in has or has[s][0] + w < has[d][0]) for s, d, w in edges)
        held = {d for s, d, w in edges if s in has and d in has and (has[s][0] + w, has[s][1] + 1) == has[d]} | ({0} if has.get(0) == (0, 0) else set())
        for given in (df, stored):
            assert tuple(validate.certificate(rows, given, seeds).first()) == (loose, len(has) - len(held), len(has))
    stored.drop()


@pytest.mark.parametrize("query", ["gr_round_trip", "fixpoint_certificate", "strategy_errors"])
def test_pairs_are_found_once(spark, monkeypatch, query):
    read, keep = [], registry.Stored.__init__
    monkeypatch.setattr(registry, "size_of", None)
    monkeypatch.setattr(registry, "ordered_rank", None)
    monkeypatch.setattr(Stored, "__init__", lambda self, df, purpose="stored", *a, **o: read.append(purpose) or keep(self, df, purpose, *a, **o))
    rows = registry.QUERIES[query](spark, SF).collect()
    assert rows and read[0] in ("unsorted", "edges", "unsolved")


@pytest.mark.parametrize("held", [0, 6, 512])
def test_paths_take_few_steps_and_keep_no_constraints(spark, monkeypatch, held):
    """A path of 70 vertices, a branch from its vertex 20, and a root of its own: the same paths however many pointers are followed at once, in fewer steps."""
    kept, keep = [], sssp.checkpointed
    monkeypatch.setattr(sssp, "HELD", held)
    monkeypatch.setattr(sssp, "checkpointed", lambda df: kept.append(spark.conf.get(sssp.PROPAGATED)) or keep(df))
    pred = {v: v - 1 if v else None for v in range(71)} | {100: 20} | {v: v - 1 for v in range(101, 130)} | {500: None}
    hops = {}
    for v, p in pred.items():
        hops[v] = 0 if p is None else hops[p] + 1
    rows = spark.createDataFrame([(v, hops[v], p) for v, p in pred.items()], "v long, hops long, pred long")
    targets, want = [70, 69, 64, 40, 129, 0, 500], set()
    for t in targets:
        v = t
        while v is not None:
            want.add((t, hops[v], v))
            v = pred[v]
    found = [tuple(r) for r in sssp.path_to(rows, spark.createDataFrame([(t,) for t in [*targets, 999]], "v long")).collect()]
    assert len(found) == len(want) and set(found) == want
    assert set(kept) == {"false"} and spark.conf.get(sssp.PROPAGATED) == "true" and len(kept) <= {0: 99, 6: 24, 512: 12}[held]
