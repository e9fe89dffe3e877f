"""MatrixMarket coordinate files.

Rows and columns count from 1. Real, integer and pattern (weight 1) entries; complex ones are refused. Symmetric and hermitian
files get the mirrored entry off the diagonal, skew-symmetric ones do not. Files are read by lines, in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.ranking import ordered_rank
from pathloom.operators.graph import check
from pathloom.sources.gr import _target
from pathloom.sources.pieces import Pieces


@dataclass(frozen=True)
class Banner:
    field: str
    symmetry: str
    rows: int
    columns: int
    entries: int


def read_banner(lines: list[str]) -> Banner:
    """The banner and size line of a file's first lines; ValueError for what cannot be read as a graph."""
    first = lines[0].lower().split() if lines else []
    if len(first) != 5 or first[:2] != ["%%matrixmarket", "matrix"]:
        raise ValueError("no MatrixMarket banner")
    if first[2] != "coordinate":
        raise ValueError(f"{first[2]} files are not graphs")
    if first[3] not in ("real", "integer", "pattern"):
        raise ValueError(f"{first[3]} entries are not supported")
    if first[4] not in ("general", "symmetric", "hermitian", "skew-symmetric"):
        raise ValueError(f"symmetry {first[4]} is not known")
    size = next((x.split() for x in lines[1:] if x.strip() and not x.startswith("%")), [])
    if len(size) != 3:
        raise ValueError("no size line")
    return Banner(first[3], first[4], *map(int, size))


def _head(path: str, step: int = 1 << 16) -> list[str]:
    """The lines of a file up to its size line, however many comments there are."""
    from pathloom.sources.gr import _open

    file, _, _ = _open(path)
    raw, at = b"", 0
    with file:
        while True:
            part = file.read_at(min(step, file.size() - at), at) if at < file.size() else b""
            raw, at = raw + part, at + len(part)
            lines = raw.decode("utf-8", "replace").splitlines(keepends=True)
            whole = [x for x in lines if x.endswith("\n") or not part]
            if not part or any(x.strip() and not x.startswith("%") for x in whole[1:]):
                return whole


def read_mtx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Banner]:
    """(vertices, edges, banner). Weights are doubles, or longs where the file holds integers or none.

    eid orders a row's edges as the file does, a mirrored entry at its entry's place. Vertices are as many as the file's rows. The
    head may be of any length. Ends out of range, lines that aren't entries and a wrong number of entries raise.
    """
    text = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    banner = read_banner(_head(path))
    data = text.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = data.orderBy("line").limit(1).select(F.col("line").alias("size_line"))
    parts = F.split(F.trim("value"), r"\s+")
    wide = 2 if banner.field == "pattern" else 3
    rows = data.join(F.broadcast(size), F.col("line") != F.col("size_line")).select("line", parts.alias("p"))
    weight = F.lit(1).cast("long") if banner.field == "pattern" else F.get("p", F.lit(2)).try_cast("long" if banner.field == "integer" else "double")
    entries = rows.select("line", F.size("p").alias("k"), (F.get("p", F.lit(0)).try_cast("long") - 1).alias("src"), (F.get("p", F.lit(1)).try_cast("long") - 1).alias("dst"), weight.alias("weight"))
    n = banner.rows
    ok = (F.col("k") >= wide) & F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1) & F.col("weight").isNotNull()
    seen = entries.agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad")).first()
    if seen["bad"] or seen["all"] != banner.entries:
        raise ValueError(f"{seen['all']} entries for {banner.entries}, {seen['bad']} of them unreadable or out of range")
    edges = entries.select("src", "dst", "weight", "line")
    if banner.symmetry in ("symmetric", "hermitian"):
        edges = edges.unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "line"))
    return spark.range(n), ordered_rank(edges, "src", ["line", "dst"], "eid").select("eid", "src", "dst", "weight"), banner


def write_mtx(edges: DataFrame, n: int, path: str, field: str = "integer", overwrite: bool = False) -> None:
    """Write edges, in the order of (src, eid), as a general coordinate file: sorted once, in pieces by tasks that are then copied to their places.

    field is real, integer or pattern (without weights). Ends must be in 0..n-1. An existing file is refused.
    """
    if field not in ("real", "integer", "pattern"):
        raise ValueError(f"{field} entries are not supported")
    check(edges, n)
    _target(path, overwrite)
    parts = [(F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string")]
    if field != "pattern":
        parts.append(F.col("weight").cast("long" if field == "integer" else "double").cast("string"))
    pieces = Pieces(edges.sparkSession)
    try:
        lines = pieces.write(edges.orderBy("src", "eid").select(F.concat_ws(" ", *parts).alias("line")), lambda b: {"line": "".join(f"{x}\n" for x in b.column("line").to_pylist()).encode()})["line"]
        pieces.join([f"%%MatrixMarket matrix coordinate {field} general\n{n} {n} {sum(rows for _, _, rows in lines)}\n".encode(), lines], path)
    finally:
        pieces.drop()


def whole_weights(edges: DataFrame) -> DataFrame:
    """Weights truncated to whole numbers, as integer files need."""
    return edges.withColumn("weight", F.col("weight").cast("long"))


def mtx_to_gr(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    from pathloom.sources.gr import write_gr

    vertices, edges, banner = read_mtx(spark, source)
    write_gr(whole_weights(edges), banner.rows, target, overwrite=overwrite)
