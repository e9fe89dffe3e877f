from collections import deque

import pytest
from graphs import dijkstra, frame, long_fixture, random_graph, solved
from pyspark.sql import functions as F

from pathloom.operators import chains, graph, partition, regions, reorder, sssp, stats
from pathloom.plans import planner


def rows_of(edges):
    out = {}
    for i, (s, d, w) in enumerate(edges):
        out.setdefault(s, []).append((d, w, i))
    return out


def queue_order(edges, n, root):
    near, seen, level, queue = rows_of(edges), [root], {root: 0}, deque([root])
    while queue:
        u = queue.popleft()
        for v, _, _ in near.get(u, ()):
            if v not in level:
                level[v] = level[u] + 1
                seen.append(v)
                queue.append(v)
    return seen + [v for v in range(n) if v not in level], level


@pytest.mark.parametrize("seed", [4, 5])
def test_bfs_order_and_layer_split(spark, seed):
    n, edges = 41, random_graph(seed)
    df = frame(spark, edges)
    want, level = queue_order(edges, n, 0)
    found = reorder.bfs_order(df, n).collect()
    assert [r["old_id"] for r in sorted(found, key=lambda r: r["new_id"])] == want
    assert {r["old_id"]: r["level"] for r in found if r["level"] is not None} == level
    cut, left, right, at = n // 2, [], [], 0
    while at < n:
        end = at
        while end < n and level.get(want[end]) == level.get(want[at]):
            end += 1
        take = min(cut, (end + 1) // 2) - len(left)
        left, right, at = left + want[at : at + take], right + want[at + take : end], end
    mapping = reorder.layer_split(reorder.bfs_order(df, n), n)
    assert [r["old_id"] for r in sorted(mapping.collect(), key=lambda r: r["new_id"])] == left + right and len(left) == cut
    moved = reorder.rebuild(df, mapping)
    reorder.check_mapping(df, moved, mapping, n)
    place = {v: i for i, v in enumerate(left + right)}
    near = rows_of(edges)
    plain = [(place[v], place[d], w) for v in left + right for d, w, _ in near.get(v, ())]
    assert [(r["src"], r["dst"], r["weight"]) for r in sorted(moved.collect(), key=lambda r: r["eid"])] == plain
    got = solved(sssp.solve(moved, sssp.sources_frame(moved, [place[0]])))
    assert {left_right[0]: x for left_right, x in (((v,), got[place[v]]) for v in (left + right) if place[v] in got)} == dijkstra(edges, [(0, 0)])
    with pytest.raises(ValueError):
        reorder.check_mapping(df, moved, mapping.limit(5), n)


def chain_graph():
    """Two-way paths of several lengths between hubs, a ring of chain vertices alone, a one-way detour and a loop back to its hub."""
    out = []

    def both(a, b, w, x):
        out.extend([(a, b, w), (b, a, x)])

    for hub in range(4):
        out.append((hub, (hub + 1) % 4, 50))
    names = iter(range(4, 200))
    for a, b, k in ((0, 1, 1), (1, 2, 2), (2, 3, 5), (0, 3, 9), (2, 2, 3)):
        way = [a, *(next(names) for _ in range(k)), b]
        for i in range(len(way) - 1):
            both(way[i], way[i + 1], i + 1, 2 * i + 1)
    ring = [next(names) for _ in range(4)]
    for i in range(4):
        both(ring[i], ring[(i + 1) % 4], 1, 1)
    return max(max(s, d) for s, d, _ in out) + 1, out


def brute_shortcuts(n, edges, cut, source):
    near = rows_of(edges)
    into = {}
    for s, d, _ in edges:
        into.setdefault(d, []).append(s)
    ok = set()
    for u in range(n):
        out = [d for d, _, _ in near.get(u, ())]
        if u != source and len(out) == 2 and len({*out, u}) == 3 and all((d < cut) == (u < cut) for d in out) and sorted(into.get(u, [])) == sorted(out):
            ok.add(u)
    found = []
    for u in range(n):
        if u in ok:
            continue
        for d, w, _ in near.get(u, ()):
            before, at, cost, hops = u, d, w, 1
            while at in ok:
                step = next((x, y) for x, y, _ in near[at] if x != before)
                before, at, cost, hops = at, step[0], cost + step[1], hops + 1
            if hops > 1 and at != u and cost < 2**31 - 1:
                found.append((u, at, cost, hops))
    return ok, found


@pytest.mark.parametrize("cut,source", [(1000, 0), (12, 7)])
def test_chain_shortcuts(spark, cut, source):
    n, edges = chain_graph()
    df = frame(spark, edges)
    ok, want = brute_shortcuts(n, edges, cut, source)
    assert {r["v"] for r in chains.chain_eligible(df, chains.halves(cut), source).collect()} == ok
    more = chains.add_shortcuts(df, cut, source)
    got = more.collect()
    assert sorted((r["src"], r["dst"], r["weight"], r["hops"]) for r in got if r["hops"] > 1) == sorted(want)
    assert sorted((r["src"], r["dst"], r["weight"]) for r in got if r["hops"] == 1) == sorted(edges)
    for r in got:  # shortcuts come first in a row
        if r["hops"] > 1:
            assert all(r["eid"] < x["eid"] for x in got if x["src"] == r["src"] and x["hops"] == 1)
    a, b = dijkstra(edges, [(source, 0)]), solved(sssp.solve(more, sssp.sources_frame(more, [source]), "owner"))
    assert {v: d for v, (d, _) in a.items()} == {v: d for v, (d, _) in b.items()}
    c = chains.shortcut_counters(df, more, cut, source).first()
    assert (c["eligible"], c["shortcuts"], c["represented_edges"], c["longest_path"]) == (len(ok), len(want), sum(x[3] for x in want), max(x[3] for x in want))


def test_loose_shortcuts_keep_distances(spark):
    n, edges = chain_graph()
    edges = [*edges, (0, 10, 1), (12, 5, 2)]
    more = chains.add_shortcuts(frame(spark, edges), 1000, 0, strict=False)
    got = solved(sssp.solve(more, sssp.sources_frame(more, [0]), "owner"))
    assert {v: d for v, (d, _) in got.items()} == {v: d for v, (d, _) in dijkstra(edges, [(0, 0)]).items()}


def test_long_fixture_has_six_shortcuts(spark):
    _, edges = long_fixture()
    assert chains.add_shortcuts(frame(spark, edges), 1026, 0).count() == 5644


def test_chain_segments(spark):
    n, edges = chain_graph()
    got = chains.chain_segments(frame(spark, edges), chains.halves(1000)).collect()
    by = {}
    for r in got:
        by.setdefault(r["segment"], []).append((r["pos"], r["v"], r["fwd"], r["rev"]))
    cost = {(s, d): w for s, d, w in edges}
    assert sorted(len(x) for x in by.values()) == [4, 7, 11]
    for x in by.values():
        x.sort()
        fwd = rev = 0
        for (_, a, _, _), (p, b, f, r) in zip(x, x[1:], strict=False):
            fwd, rev = fwd + cost[a, b], rev + cost[b, a]
            assert (f, r) == (fwd, rev) and p == x.index((p, b, f, r))


def test_region_index(spark):
    edges = random_graph(6)
    bounds, width = [0, 13, 41], 4
    got = {r["v"]: (r["owner"], r["region"], r["slot"]) for r in regions.region_index(frame(spark, edges), bounds, width).collect()}
    near, want = rows_of(edges), {}
    for part in range(2):
        lo, hi = bounds[part], bounds[part + 1]
        region = 0
        for seed in range(lo, hi):
            if seed in want:
                continue
            members = [seed]
            want[seed] = (part, region, 0)
            for u in members:
                for v, _, _ in near.get(u, ()):
                    if lo <= v < hi and v not in want and len(members) < width:
                        want[v] = (part, region, len(members))
                        members.append(v)
            region += 1
    assert got == want


def test_partitions_and_statistics(spark):
    edges = random_graph(7)
    df, n = frame(spark, edges), 41
    degree = [sum(s == v for s, _, _ in edges) for v in range(n)]
    first = [sum(degree[:v]) for v in range(n + 1)]
    want = [0]
    for i in range(1, 4):
        goal = len(edges) * i // 4
        up = next(v for v in range(n + 1) if first[v] >= goal)
        at = up - 1 if 0 < up < n and goal - first[up - 1] <= first[up] - goal else up
        want.append(min(max(at, i), n - (4 - i)))
    assert partition.edge_balanced(df, n, 4) == [*want, n]
    assert partition.edge_balanced(df.where("false"), n, 4) == [0, 1, 2, 3, n]
    assert partition.vertex_balanced(10, 3) == [0, 3, 6, 10]
    assert [partition.cut_percent(10, p) for p in (None, 0, 30, 99, 100)] == [[0, 5, 10], [0, 5, 10], [0, 3, 10], [0, 9, 10], [0, 5, 10]]
    s = stats.graph_stats(df, spark.range(n)).first()
    assert (s["vertices"], s["edges"], s["max_degree"], s["diameter"]) == (n, len(edges), max(degree), None)
    assert abs(s["avg_degree"] - sum(degree) / n) < 1e-12
    empty = stats.graph_stats(df.where("false"), spark.range(0)).first()
    assert (empty["vertices"], empty["edges"], empty["avg_weight"]) == (0, 0, None)
    assert graph.lightest_parallel(df).count() == len({(s, d) for s, d, _ in edges})
    assert partition.owned_edges(df, [0, 20, n], 1).where("src < 20").count() == 0
    near = {d for s, d, _ in edges if s < 13 <= d}
    two = near | {d for s, d, _ in edges if s in near and d >= 13}
    assert {r["v"] for r in partition.ghost_closure(df, [0, 13, n], 0, 2).collect()} == two


@pytest.mark.parametrize("run_edges", [3, 12])
def test_order_in_runs_of_levels(spark, run_edges):
    edges = random_graph(8) + [(u, u + 1, 1) for u in range(40, 60)] + [(3, 40, 0)]
    got = reorder.bfs_order(frame(spark, edges), 62, run_edges=run_edges).collect()
    order, level = queue_order(edges, 62, 0)
    assert [r["old_id"] for r in sorted(got, key=lambda r: r["new_id"])] == order
    assert {r["old_id"]: r["level"] for r in got if r["level"] is not None} == level


def test_regions_as_an_overlay(spark):
    for seed, width, kind in ((1, 8, "long"), (6, 16, "double")):
        edges = random_graph(seed)
        df = frame(spark, edges).withColumn("weight", F.col("weight").cast(kind))
        seeds = spark.createDataFrame([(0, 0, 0), (1, 25, 3), (1, 2, 0)], "q long, v long, dist long")
        got = regions.solve_by_regions(df, seeds, width).collect()
        for q, own in ((0, [(0, 0)]), (1, [(25, 3), (2, 0)])):
            assert {r["v"]: r["dist"] for r in got if r["q"] == q} == {v: d for v, (d, _) in dijkstra(edges, own).items()}
    closed = regions.region_closure(frame(spark, [(0, 1, 5), (0, 1, 2), (1, 2, 0), (2, 0, 1), (2, 9, 4), (9, 8, 3)]), None, 4).collect()
    assert {tuple(r) for r in closed} == {(2, 2, 0, 0, True), (2, 0, 1, 1, False), (2, 1, 3, 2, False), (9, 9, 0, 0, True), (9, 8, 3, 1, False)}


def test_stride_sample(spark):
    df = frame(spark, [(i, i * 7 % 5000, i % 13) for i in range(5000)])
    a, b = stats.stride_sample(df, 10), stats.stride_sample(df.repartition(7), 10)
    assert 350 < a.count() < 650 and not a.exceptAll(b).count()
    found = stats.weight_estimate(df, 10).first()
    assert abs(found["avg_weight"] - sum(i % 13 for i in range(5000)) / 5000) <= found["error"] < 1
    assert tuple(stats.weight_estimate(df.where("false"), 10).first()) == (0, None, None)
    assert planner.sampled_delta(df, 5000, 10) == 4 and planner.sampled_delta(df.where("false"), 10) == planner.LEAST_DELTA


def test_region_index_holds_no_owner_as_a_table(spark):
    """Owners come as sorted streams: no group of a whole owner is built, and owners without edges have their vertices too."""
    edges = random_graph(8, n=60, m=300)
    found = regions.region_index(frame(spark, edges), [0, 30, 61, 70], 5)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert sorted(r["v"] for r in rows) == list(range(70)) and {r["slot"] for r in rows if r["owner"] == 2} == {0}
    assert max(r["slot"] for r in rows) == 4


def test_few_boundary_vertices_are_searched_from(monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    src, dst, weight = r.integers(0, 40, 160), r.integers(0, 40, 160), r.integers(0, 9, 160)
    boundary = np.array([0, 7, 39])
    dist, hops = regions._least_paths(40, src, dst, weight)
    monkeypatch.setattr(regions, "_least_paths", lambda *_: 1 / 0)
    got = regions._paths_from(boundary[:1], 40, src, dst, weight), regions._paths_from(boundary[1:], 40, src, dst, weight)
    near = hops[boundary] < regions.INF
    assert (np.concatenate([got[0][1], got[1][1]]) == hops[boundary]).all() and (np.concatenate([got[0][0], got[1][0]])[near] == dist[boundary][near]).all()
