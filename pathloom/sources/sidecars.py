"""Permutations, oracle distances, distance texts and benchmark lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.graph import INT_MAX
from pathloom.sources.gr import _open, _target


def write_permutation(mapping: DataFrame, n: int, path: str) -> None:
    """path.perm.u32 (new to old) and path.invperm.u32 (old to new), n little-endian u32 each. Existing files are refused.

    The formats are one array; the driver holds 8 bytes per vertex.
    """
    targets = [_target(f"{path}.{kind}.u32", False)[1:] for kind in ("perm", "invperm")]
    new, old = np.zeros(n, dtype="<u4"), np.zeros(n, dtype="<u4")
    for r in mapping.toLocalIterator(prefetchPartitions=True):
        new[r["new_id"]], old[r["old_id"]] = r["old_id"], r["new_id"]
    for (system, inside), values in zip(targets, (new, old), strict=True):
        with system.open_output_stream(inside) as out:
            out.write(values.tobytes())


def read_permutation(spark: SparkSession, path: str) -> DataFrame:
    """new_id, old_id of path.perm.u32."""
    return _numbers(spark, f"{path}.perm.u32", "<u4").select(F.col("id").alias("new_id"), F.col("value").alias("old_id"))


def _size(path: str) -> int:
    file, _, _ = _open(path)
    with file:
        return file.size()


def _numbers(spark: SparkSession, path: str, kind: str, per_task: int = 1 << 20) -> DataFrame:
    """id, value of an array of 4-byte numbers; a task reads its range of the file, which every task must reach."""
    n = _size(path) // 4
    tasks = max(1, -(-n // per_task))

    def run(batches):
        for b in batches:
            for part in b.column("id").to_pylist():
                lo, hi = n * part // tasks, n * (part + 1) // tasks
                file, _, _ = _open(path)
                with file:
                    values = np.frombuffer(file.read_at(4 * (hi - lo), 4 * lo), dtype=kind).astype(np.int64)
                for at in range(0, len(values), 1 << 16):
                    own = values[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo + at, lo + at + len(own))), pa.array(own)], names=["id", "value"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long, value long")


def write_distances_text(found: DataFrame, path: str) -> None:
    """One line `id distance`, or `id INF`, per row of found(v, dist), in the order of v."""
    found.orderBy("v").select(F.concat_ws(" ", F.col("v").cast("string"), F.coalesce(F.col("dist").cast("string"), F.lit("INF"))).alias("value")).write.text(path)


def read_distances_text(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].cast("long").alias("v"), F.when(parts[1] != "INF", parts[1]).cast("long").alias("dist"))


def write_oracle(found: DataFrame, n: int, path: str) -> None:
    """n little-endian int32 distances; INT_MAX where not reached. A distance that doesn't fit raises."""
    values = np.full(n, INT_MAX, dtype="<i4")
    for r in found.where("dist IS NOT NULL").toLocalIterator(prefetchPartitions=True):
        if r["dist"] >= INT_MAX:
            raise ValueError("a distance does not fit 32 bits")
        values[r["v"]] = r["dist"]
    _, system, inside = _target(path, False)
    with system.open_output_stream(inside) as out:
        out.write(values.tobytes())


def read_oracle(spark: SparkSession, path: str, n: int) -> DataFrame:
    """v, dist (null where INT_MAX). ValueError unless the file has exactly n values."""
    values = _size(path) // 4
    if values != n:
        raise ValueError(f"{values} values for {n} vertices")
    return _numbers(spark, path, "<i4").select(F.col("id").alias("v"), F.when(F.col("value") != INT_MAX, F.col("value")).alias("dist"))


def bench_line(**values) -> str:
    return "BENCH " + " ".join(f"{k}={v}" for k, v in values.items())


def read_bench_lines(lines: DataFrame) -> DataFrame:
    """fields: map of each line `BENCH k=v ...` of a text table; other lines are skipped."""
    return lines.where(F.col("value").startswith("BENCH ")).select(F.str_to_map(F.expr("substring(value, 7)"), F.lit(" "), F.lit("=")).alias("fields"))


def check_bench(rows: DataFrame) -> DataFrame:
    """Rows of read_bench_lines that are not valid: not correct, or a time that is missing or not positive."""
    return rows.where(~F.coalesce((F.col("fields")["correct"] == "1") & (F.col("fields")["solve_ms"].try_cast("double") > 0), F.lit(False)))
