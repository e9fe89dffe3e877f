"""Bounded batches and free column names."""

import pyarrow as pa

from pathloom.functions.batches import BYTES, bound_batches, unused


def test_names_that_are_free():
    assert unused(["a", "B_", "_x"], "A", "b", "_x", "new", "new") == ["A_", "b", "_x_", "new", "new_"]


def test_batches_end_at_their_bytes(spark):
    session = spark.newSession()
    bound_batches(session, 1 << 16)
    assert session.conf.get(BYTES) == str(1 << 16)
    bound_batches(session, 1)
    assert session.conf.get(BYTES) == str(1 << 16)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows = session.range(0, 100, 1, 1).selectExpr("repeat('x', 10000) AS t").mapInArrow(sizes, "n long").collect()
    assert sum(r["n"] for r in rows) == 100 and max(r["n"] for r in rows) <= 8
