"""Registered graph queries against their SQL on the smallest tables, where these are present."""

import os

import pytest

import __spark_entry__
from pathloom.plans import registry

DATA = "/root/testdata/sf0.001"
QUICK = (
    "graph_edges", "graph_stats", "partition_edge_balanced", "sssp_frontier", "sssp_predecessors", "sssp_batch", "chain_shortcuts", "chain_segments", "timing_summary",
    "bfs_positions", "layer_positions", "rebuilt_edges", "permutation_round_trip", "oracle_round_trip", "mtx_to_gr", "augmented_round_trip", "loose_shortcuts",
    "shortcut_counters", "bench_checks", "run_sinks", "first_mismatch", "conservation", "partition_cut_percent", "ghost_closure_2", "bags", "path_steps",
    "sssp_multi_topk", "sssp_dynamic_delta", "reordered_cut", "queue_strategies", "hub_star", "hub_blocks", "sssp_delta_stepping",
    "weight_estimate", "gr_source", "region_closure", "fixpoint_certificate", "diameter_rule", "sssp_queue_filter", "owned_slice", "gr_round_trip",
)


def rows(frame):
    names = sorted(frame.columns)
    return sorted(str([None if x != x else x for x in r]) for r in frame[names].astype(object).where(frame[names].notna(), None).values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    import duckdb
    import pandas as pd

    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    found = registry.QUERIES[name](spark, DATA)
    got = pd.DataFrame([tuple(r) for r in found.collect()], columns=found.columns, dtype=object)
    cursor = db.execute(registry.ORACLES[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[c[0] for c in cursor.description], dtype=object)
    assert rows(got) == rows(want)


def test_registry():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 210
