"""Joins whose sides grow with the input are never broadcast, whatever their size says."""

from pathloom.functions.lineage import checkpointed
from pathloom.llm import components, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_and_fingerprints_broadcast_nothing(spark):
    nodes = spark.createDataFrame([(i,) for i in range(200)] + [(1 << 40,), (3 << 40,)], "fp long")
    for crowd in (4, 1000):
        assert "BroadcastExchange" not in plan(simhash.linked_pairs(nodes, crowd=crowd))
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    found = simhash.near_duplicates(docs)
    assert "BroadcastExchange" not in plan(found)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3}
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 8)], "a long, b long")
    assert "BroadcastExchange" not in plan(components._star_step(edges))
    assert "BroadcastExchange" not in plan(components._star_step(checkpointed(edges)))
