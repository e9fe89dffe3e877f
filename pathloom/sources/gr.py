"""Binary CSR files (.gr).

Little-endian: version, edge width, n, m (u64 each); n row ends (u64); m destinations (u32); four bytes of padding if m
is odd; m weights (i32, or f32; absent if the edge width is 0, then every weight is 0); up to eight further bytes are accepted.
Reading is split by vertices: a task reads its rows' ends, destinations and weights and nothing else.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from pathloom.functions.lineage import sweep
from pathloom.operators.graph import INT_MAX, check
from pathloom.operators.partition import row_starts
from pathloom.sources.pieces import Pieces

HEAD = 32


def _open(path: str):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inside), system, inside


def header(path: str) -> dict[str, int]:
    """version, width, n, m and size of a file; ValueError if the parts do not fit its size."""
    file, _, _ = _open(path)
    with file:
        size = file.size()
        if size < HEAD:
            raise ValueError("too short for a header")
        version, width, n, m = struct.unpack("<4Q", file.read_at(HEAD, 0))
    if width not in (0, 4):
        raise ValueError(f"edge width {width} is not known")
    need = HEAD + 8 * n + 4 * m + (4 * (m % 2) + 4 * m if width else 0)
    if not need <= size <= need + 4 * (m % 2) + 8:
        raise ValueError(f"{size} bytes do not fit {n} vertices and {m} edges")
    return {"version": version, "width": width, "n": n, "m": m, "size": size}


def read_gr(spark: SparkSession, path: str, floats: bool = False, strict: bool = True, default_weight: int | None = None, rows_per_task: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a file. eid is the edge's place in the file.

    strict: version 1, and weights present unless default_weight is given. In any case rows must ascend, destinations be in range and weights
    not negative, or the read raises. Without weights they are default_weight, or 0. The path must be readable by every task.
    """
    head = header(path)
    n, width = head["n"], head["width"]
    if strict and head["version"] != 1:
        raise ValueError(f"version {head['version']}")
    if strict and not width and default_weight is None:
        raise ValueError("no weights; give default_weight")
    kind = "double" if floats else "long"
    tasks = max(1, -(-n // rows_per_task))

    def run(batches):
        for b in batches:
            for part in b.column("id").to_pylist():
                yield from rows_of(path, head, n * part // tasks, n * (part + 1) // tasks, ("eid", "src", "dst", "weight"), floats, default_weight)

    edges = spark.range(0, tasks, 1, tasks).mapInArrow(run, f"eid long, src long, dst long, weight {kind}")
    return spark.range(n), edges


def rows_of(path: str, head: dict[str, int], lo: int, hi: int, columns: tuple[str, ...], floats: bool = False, default_weight: int | None = None) -> Iterator[pa.RecordBatch]:
    """Edges of the vertices lo to hi - 1, as batches of the named columns; only their parts of the file are read, destinations and weights only if they are asked for."""
    n, m, width = head["n"], head["m"], head["width"]
    file, _, _ = _open(path)
    with file:
        first = lo - 1 if lo else 0
        ends = np.frombuffer(file.read_at(8 * (hi - first), HEAD + 8 * first), dtype="<u8").astype(np.int64)
        ends = ends if lo else np.concatenate([[0], ends])
        if (np.diff(ends) < 0).any() or ends[-1] > m or (hi == n and ends[-1] != m):
            raise ValueError("row ends do not ascend to the number of edges")
        a, z = int(ends[0]), int(ends[-1])
        held = {"eid": np.arange(a, z), "src": np.repeat(np.arange(lo, hi), np.diff(ends))}
        at = HEAD + 8 * n
        if "dst" in columns:
            held["dst"] = np.frombuffer(file.read_at(4 * (z - a), at + 4 * a), dtype="<u4").astype(np.int64)
            if (held["dst"] >= n).any():
                raise ValueError("a destination is out of range")
        if "weight" in columns:
            weight = np.frombuffer(file.read_at(4 * (z - a), at + 4 * (m + m % 2 + a)), dtype="<f4" if floats else "<i4") if width else np.full(z - a, default_weight or 0)
            if (weight < 0).any() or (floats and np.isnan(weight).any()):
                raise ValueError("a weight is negative")
            held["weight"] = weight.astype(np.float64 if floats else np.int64)
    for s in range(0, max(1, z - a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(held[c][s : s + (1 << 16)]) for c in columns], names=list(columns))


@dataclass
class Vertices(InputPartition):
    """The edges of the vertices lo to hi - 1."""

    lo: int
    hi: int


class GrReader(DataSourceReader):
    """Tasks by ranges of vertices. Filters that compare src with numbers narrow the vertices that are read; Spark hands them on if spark.sql.python.filterPushdown.enabled is set."""

    def __init__(self, options, columns: tuple[str, ...]):
        self.path, self.columns = options["path"], columns
        self.floats, self.rows = options.get("floats", "false").lower() == "true", int(options.get("rowsPerTask", 1 << 20))
        self.default = int(options["defaultWeight"]) if "defaultWeight" in options else None
        self.head = header(self.path)
        strict = options.get("strict", "true").lower() == "true"
        if strict and self.head["version"] != 1:
            raise ValueError(f"version {self.head['version']}")
        if strict and not self.head["width"] and self.default is None:
            raise ValueError("no weights; give defaultWeight")
        self.spans = [(0, self.head["n"])]

    def _narrow(self, spans: list[tuple[int, int]]) -> None:
        both = [(max(a, c), min(b, d)) for a, b in self.spans for c, d in spans]
        self.spans = sorted((a, b) for a, b in both if a < b)

    def pushFilters(self, filters):  # noqa: N802
        n = self.head["n"]
        for f in filters:
            if getattr(f, "attribute", None) == ("src",):
                if isinstance(f, (EqualTo, In)):
                    wanted = [f.value] if isinstance(f, EqualTo) else f.value
                    self._narrow([(v, v + 1) for v in sorted({v for v in wanted if v is not None})])
                    continue
                bound = {GreaterThan: lambda v: (v + 1, n), GreaterThanOrEqual: lambda v: (v, n), LessThan: lambda v: (0, v), LessThanOrEqual: lambda v: (0, v + 1), IsNotNull: lambda _: (0, n)}.get(type(f))
                if bound:
                    self._narrow([bound(getattr(f, "value", 0))])
                    continue
            yield f

    def partitions(self):
        return [Vertices(lo, min(lo + self.rows, hi)) for a, hi in self.spans for lo in range(a, hi, self.rows)] or [Vertices(0, 0)]

    def read(self, partition):
        if partition.lo < partition.hi:
            yield from rows_of(self.path, self.head, partition.lo, partition.hi, self.columns, self.floats, self.default)


class GrSource(DataSource):
    """spark.read.format("gr"): the edges of a file in the option path. Options: floats, strict, defaultWeight, rowsPerTask. A schema of some of the columns reads only these."""

    @classmethod
    def name(cls) -> str:
        return "gr"

    def schema(self) -> str:
        return f"eid long, src long, dst long, weight {'double' if self.options.get('floats', 'false').lower() == 'true' else 'long'}"

    def reader(self, schema) -> GrReader:
        unknown = [f.name for f in schema if f.name not in ("eid", "src", "dst", "weight")]
        if unknown:
            raise ValueError(f"no column {unknown[0]} in a .gr file")
        return GrReader(self.options, tuple(f.name for f in schema))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it see filters."""
    spark.dataSource.register(GrSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_gr(edges: DataFrame, n: int, path: str, floats: bool = False, overwrite: bool = False) -> None:
    """Write edges, in the order of (src, eid), as a .gr file: sorted once, in pieces by tasks that are then copied to their places; the driver gets the pieces' sizes.

    Ends must be in 0..n-1, weights not negative and, unless floats, below 2**31. An existing file is refused.
    """
    check(edges, n)
    if not floats and edges.where(F.col("weight") > INT_MAX).limit(1).count():
        raise ValueError("a weight does not fit 32 bits")
    _target(path, overwrite)
    pieces, form = Pieces(edges.sparkSession), "<f4" if floats else "<i4"
    whole = lambda b, column, kind: b.column(column).to_numpy().astype(kind).tobytes()
    try:
        ends = pieces.write(row_starts(edges, n).select("id", (F.col("first") + F.col("degree")).alias("end")).orderBy("id").select("end"), lambda b: {"end": whole(b, "end", "<u8")})["end"]
        arrays = pieces.write(edges.select("src", "eid", "dst", F.col("weight").cast("double" if floats else "long").alias("weight")).orderBy("src", "eid").select("dst", "weight"), lambda b: {"dst": whole(b, "dst", "<u4"), "weight": whole(b, "weight", form)})
        # What was shuffled to sort is not needed beside the file.
        sweep(edges.sparkSession)
        m = sum(rows for _, _, rows in arrays["dst"])
        pieces.join([struct.pack("<4Q", 1, 4, n, m), ends, arrays["dst"], b"\0" * 4 * (m % 2), arrays["weight"]], path)
    finally:
        pieces.drop()


def _target(path: str, overwrite: bool):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if not overwrite and system.get_file_info(inside).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    return None, system, inside


def same_edges(a: DataFrame, b: DataFrame) -> bool:
    """Whether two edge tables are equal, order by eid included."""
    x, y = (e.select("eid", "src", "dst", "weight") for e in (a, b))
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count()
