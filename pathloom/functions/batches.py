"""How much of a table is handed to Python at a time, and column names that a table leaves free."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """From now on Arrow batches to Python end at `size` bytes (a longer row is a batch of its own). A bound that the session has set stays."""
    if spark.conf.get(BYTES, None) is None:
        spark.conf.set(BYTES, str(size))


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores added as it needs to differ from all taken ones, upper case or lower."""
    known, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out
