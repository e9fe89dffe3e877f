"""One file out of pieces that tasks write. The driver learns the pieces' sizes, never their bytes."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from pathloom.functions.lineage import delete, shared_folder

CHUNK = 1 << 22


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Pieces:
    """Sorted tables written piece by piece below the shared folder, and files made of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark, "pieces")
        system, inside = _system(self.folder.removeprefix("file:"))
        system.create_dir(inside, recursive=True)

    def write(self, rows: DataFrame, encode: Callable[[pa.RecordBatch], dict[str, bytes]]) -> dict[str, list[tuple[str, int, int]]]:
        """(path, bytes, rows) of the pieces of each section that encode makes of a batch, in the order of rows, which are sorted as a whole."""
        folder = self.folder.removeprefix("file:")

        def run(batches):
            at, out, size, held = TaskContext.get(), {}, defaultdict(int), 0
            system, inside = _system(folder)
            # An attempt writes files of its own; those of the one that ends count.
            name = f"{at.stageId()}-{at.partitionId()}-{at.taskAttemptId()}"
            try:
                for b in batches:
                    held += b.num_rows
                    for section, raw in encode(b).items():
                        if section not in out:
                            out[section] = system.open_output_stream(f"{inside}/{section}-{name}")
                        out[section].write(raw)
                        size[section] += len(raw)
            finally:
                for f in out.values():
                    f.close()
            cols = [[*out], [at.partitionId()] * len(out), [f"{folder}/{s}-{name}" for s in out], [size[s] for s in out], [held] * len(out)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["section", "part", "path", "size", "rows"])

        made = defaultdict(list)
        # One row for each section of a partition.
        for r in sorted(rows.mapInArrow(run, "section string, part long, path string, size long, rows long").collect(), key=lambda r: r["part"]):
            made[r["section"]].append((r["path"], r["size"], r["rows"]))
        return made

    def join(self, parts: list[bytes | list[tuple[str, int, int]]], path: str) -> None:
        """The file of some bytes and pieces in this order. Into a folder that all tasks reach every piece is copied to its place by a task; a store that only takes streams gets one from the driver, a chunk at a time."""
        places, size = [], 0
        for x in parts:
            for piece, n in [(x, len(x))] if isinstance(x, bytes) else [p[:2] for p in x]:
                places.append((piece, size, n))
                size += n
        system, inside = _system(path)
        if system.type_name != "local":
            with system.open_output_stream(inside) as out:
                for piece, _, _ in places:
                    for raw in [piece] if isinstance(piece, bytes) else _chunks(piece):
                        out.write(raw)
            return
        with open(inside, "wb") as out:
            out.truncate(size)
            for piece, at, _ in places:
                if isinstance(piece, bytes):
                    out.seek(at)
                    out.write(piece)

        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    to, done = os.open(inside, os.O_WRONLY), r["at"]
                    try:
                        for raw in _chunks(r["piece"]):
                            done += os.pwrite(to, raw, done)
                    finally:
                        os.close(to)
                    yield pa.RecordBatch.from_arrays([pa.array([done - r["at"]])], names=["copied"])

        own = [p for p in places if not isinstance(p[0], bytes)]
        if own:
            asked = self.spark.createDataFrame(own, "piece string, at long, n long")
            copied = asked.repartition(len(own)).mapInArrow(run, "copied long").agg({"copied": "sum"}).first()[0]
            if copied != sum(n for _, _, n in own):
                raise OSError(f"{path}: {copied} bytes copied")

    def drop(self) -> None:
        delete(self.spark, self.folder)


def _chunks(path: str):
    system, inside = _system(path)
    with system.open_input_stream(inside) as f:
        while raw := f.read(CHUNK):
            yield raw
