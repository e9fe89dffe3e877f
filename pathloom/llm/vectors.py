"""Near-duplicate embeddings by product quantisation.

A coarse codebook parts the unit vectors of a label into inverted lists. Within a list a vector is stored as the codes of its residual's subspaces, with the
distance between the vector and what its codes stand for. Every vector searches the lists that may hold a neighbour: tables of the distances from its subspaces to all codewords
give its distance to each stored code, and the triangle inequality with the stored error rules out all but a few, of which the exact cosine decides.

Codebooks are fitted on a bounded sample; all vectors are indexed and all are queries. Lists are searched in tiles of bounded size on both sides, so a hot list is many tasks.
Vectors within half the threshold's distance of their list's centre are all linked to each other: such a core is counted, not compared, so a
crowd of copies that a third of all rows are in costs as many rows as it has members.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.batches import bound_batches
from pathloom.functions.lineage import checkpointed
from pathloom.llm.components import connected_components

#: Vectors that codebooks are fitted on, at most.
SAMPLE = 8192
#: Lists: this many times the square root of the number of vectors, as long as the sample has 16 vectors for each.
LISTS = 0.25
#: Subspaces of a residual and codewords of each.
SPACES, WORDS = 8, 256
#: Vectors of a tile, on either side.
TILE = 2048
#: Cells of lists that may be broadcast.
FEW_CELLS = 100_000


def unit(vector: list | None) -> np.ndarray | None:
    """The vector in double precision with length 1; None for null, empty and zero vectors, and for those with a null or non-finite component."""
    if not vector or None in vector:
        return None
    x = np.asarray(vector, dtype=np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def centres_of(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from rows far from each other in turn, with a fixed seed; at most as many centres as there are distinct rows."""
    x = np.unique(x, axis=0) if len(x) <= k else x
    if len(x) <= k:
        return x
    r, picked = np.random.default_rng(7), [0]
    far = _squares(x, x[:1])[:, 0]
    while len(picked) < k and far.max() > 1e-12:
        picked.append(int(r.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, _squares(x, x[picked[-1:]])[:, 0])
    centres = x[picked]
    for _ in range(rounds):
        own = _squares(x, centres).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Codebooks:
    """Coarse centres and the codewords of residuals' subspaces, for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = centres_of(sample, lists)
        own = _squares(sample, self.coarse).argmin(axis=1)
        rest = sample - self.coarse[own]
        edges = np.linspace(0, sample.shape[1], min(SPACES, sample.shape[1]) + 1).astype(int)
        self.spaces = list(pairwise(edges.tolist()))
        self.words = [centres_of(rest[:, a:b], WORDS) for a, b in self.spaces]
        self.apart = np.sqrt(_squares(self.coarse, self.coarse))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """list, distances to all centres, codes (a byte each), error of what the codes stand for."""
        far = np.sqrt(_squares(x, self.coarse))
        own = far.argmin(axis=1)
        rest = x - self.coarse[own]
        codes, missed = np.empty((len(x), len(self.spaces)), dtype=np.uint8), np.zeros(len(x))
        for i, (a, b) in enumerate(self.spaces):
            square = _squares(rest[:, a:b], self.words[i])
            codes[:, i] = square.argmin(axis=1)
            missed += square[np.arange(len(x)), codes[:, i]]
        return own, far, codes, np.sqrt(missed)

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distances from each subspace of the queries' residuals in that list to the codewords."""
        rest = x - self.coarse[at]
        return [_squares(rest[:, a:b], self.words[i]) for i, (a, b) in enumerate(self.spaces)]


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    """Vectors stored as bytes of doubles, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, width)


def _unit_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """row (unique), vec_id, label, dim, x: unit vectors as bytes of doubles, null where a vector cannot link."""

    def run(batches):
        for b in batches:
            units = [unit(v) if known else None for v, known in zip(b.column("v").to_pylist(), b.column("label").is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([None if u is None else len(u) for u in units], pa.int32()), pa.array([None if u is None else u.astype("<f8").tobytes() for u in units], pa.binary())], names=["vec_id", "label", "dim", "x"])

    bound_batches(vectors.sparkSession)
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return plain.mapInArrow(run, "vec_id long, label string, dim int, x binary").withColumn("row", F.monotonically_increasing_id())


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict[int, Codebooks]:
    """Codebooks for each dimension, on the rows with the least hashes: about `sample` of all dimensions together, of each dimension some.

    A hash's bound leaves about twice as many rows as are wanted before any are ordered, so that much moves, however many there are.
    """
    known, bits = rows.where("x IS NOT NULL"), 1 << 40
    sizes = {r["dim"]: r["count"] for r in known.groupBy("dim").count().collect()}  # one row per dimension
    out = {}
    for d, n in sorted(sizes.items()):
        want = -(-sample * n // sum(sizes.values()))
        h = F.pmod(F.xxhash64("x", "vec_id"), F.lit(bits))
        drawn = known.where((F.col("dim") == d) & (h < F.lit(bits if n <= 4 * want else 2 * want * bits // n))).select("x", h.alias("h")).orderBy("h", "x").limit(want).collect()
        x = np.frombuffer(b"".join(r["x"] for r in drawn), dtype="<f8").reshape(-1, d)
        out[d] = Codebooks(x, max(1, min(round(LISTS * n**0.5), len(x) // 16)))
    return out


def _tied(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected to by the pairs (a, b)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _tile(sent, threshold: float, chord: float):
    """One tile of a list: stored rows against queries. Gives (row, null, links) for queries with links, and (row, other, 0): edges that tie together what the tile links."""

    def run(key: tuple, stored: pa.Table, asked: pa.Table) -> pa.Table:
        _, dim, at, *_ = (k.as_py() for k in key)
        if not stored.num_rows or not asked.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        book, x, q = sent.value[dim], _numbers(stored.column("x"), dim), _numbers(asked.column("x"), dim)
        own, ask = stored.column("row").to_numpy(), asked.column("row").to_numpy()
        codes = np.frombuffer(b"".join(stored.column("codes").to_pylist()), dtype=np.uint8).reshape(len(x), -1)
        reach = (chord + stored.column("missed").to_numpy() + 1e-9) ** 2
        links, left, right = np.zeros(len(q), dtype=np.int64), [], []
        for i in range(0, len(q), 128):
            far = np.zeros((len(q[i : i + 128]), len(x)))
            for j, table in enumerate(book.tables(q[i : i + 128], at)):
                far += table[:, codes[:, j]]
            a, b = np.nonzero(far <= reach)
            for s in range(0, len(a), 1 << 15):
                u, v = a[s : s + (1 << 15)] + i, b[s : s + (1 << 15)]
                linked = (np.einsum("ij,ij->i", q[u], x[v]) >= threshold) & (ask[u] != own[v])
                u, v = u[linked], v[linked]
                links += np.bincount(u, minlength=len(q))
                # Ties of what came before stand for it.
                both = _tied(np.concatenate([*left, u]), np.concatenate([*right, v + len(q)]), len(q) + len(x))
                moved = np.flatnonzero(both != np.arange(len(both)))
                left, right = [moved], [both[moved]]
        nodes = np.concatenate([ask, own])
        a, b = (nodes[np.concatenate(y)] if y else np.zeros(0, dtype=np.int64) for y in (left, right))
        some = links > 0
        return pa.table({"row": np.concatenate([ask[some], a]), "other": pa.array(np.concatenate([ask[some], b]), mask=np.arange(some.sum() + len(b)) < some.sum()), "links": np.concatenate([links[some], np.zeros(len(a), dtype=np.int64)])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", slack: float | None = None, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable over links, itself included), kept (vec_id is the component's): one row per row.

    Rows link when labels are equal and the cosine is `threshold` or more. Null labels link with nothing, nor do vectors that are null, empty, zero, or hold null or non-finite
    components, nor vectors of different dimensions. Repeated rows are rows of their own and link with each other. A null id is no candidate for the smallest; where all of a
    component's ids are null so is component_id, and kept is false. An empty table gives no rows. Other columns do not matter.

    A list is searched if a neighbour of the query may lie beyond the border between the list and the query's own: one that differs by `slack` of the greatest
    distance in that direction. With slack 1 no link is lost. By default it is 4 / sqrt(dimension), or 1 if less: four standard deviations of a difference that has no preferred
    direction. Cores are searched whatever the border.
    """
    if not 0 < threshold <= 1 or slack is not None and not 0 < slack <= 1:
        raise ValueError("threshold and slack are above 0 and at most 1")
    chord = float(np.sqrt(2 - 2 * threshold))
    half = max(0.0, (chord - 1e-7) / 2)
    rows = checkpointed(_unit_rows(vectors, id_col, vec_col, label_col))
    books = fit(rows, sample)
    sent = rows.sparkSession.sparkContext.broadcast(books)  # at most `sample` vectors' worth of centres and codewords

    def index(batches):
        for b in batches:
            for dim in sorted({d for d in b.column("dim").to_pylist() if d in sent.value}):
                part = b.filter(pc.equal(b.column("dim"), dim))
                book, x = sent.value[dim], _numbers(part.column("x"), dim)
                own, far, codes, missed = book.encode(x)
                near = far[np.arange(len(x)), own]
                border = (far**2 - near[:, None] ** 2) / np.maximum(2 * book.apart[own], 1e-12)
                may = (border <= (min(1.0, 4 / dim**0.5) if slack is None else slack) * chord + 1e-9) | (far <= chord + half + 1e-9)
                may[np.arange(len(x)), own] = True
                probes = [[{"list": int(c), "far": float(far[i, c])} for c in np.flatnonzero(may[i])] for i in range(len(x))]
                kind = pa.list_(pa.struct([("list", pa.int32()), ("far", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("label"), part.column("dim"), part.column("x"), pa.array(own, pa.int32()), pa.array(near), pa.array(near <= half), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed), pa.array(probes, kind)], names=["row", "label", "dim", "x", "list", "near", "core", "codes", "missed", "probes"])

    schema = "row long, label string, dim int, x binary, list int, near double, core boolean, codes binary, missed double, probes array<struct<list: int, far: double>>"
    indexed = checkpointed(rows.where("x IS NOT NULL AND label IS NOT NULL").select("row", "label", "dim", "x").mapInArrow(index, schema))

    place = ["label", "dim", "list"]
    held = checkpointed(indexed.groupBy(*place, "core").agg(F.count(F.lit(1)).alias("held"), F.min("row").alias("first"), F.max("near").alias("widest")))
    asking = indexed.select("row", "label", "dim", "x", F.col("list").alias("own"), F.col("core").alias("inner"), F.explode("probes").alias("p")).select("row", "label", "dim", "x", "own", "inner", F.col("p.list").alias("list"), F.col("p.far").alias("far"))
    at_home = (F.col("list") == F.col("own")) & F.col("inner")
    # A whole core is near, or none of it is, or its members are searched.
    fate = F.when(~F.col("core"), "search").when(at_home | (F.col("far") + F.col("widest") <= chord - 1e-7), "all").when(F.col("far") - F.col("widest") > chord + 1e-7, "none").otherwise("search")
    few = held.count() <= FEW_CELLS
    beside = lambda t: F.broadcast(t) if few else t
    met = asking.join(beside(held), place).withColumn("fate", fate)
    whole = met.where("fate = 'all'").select("row", F.col("first").alias("other"), (F.col("held") - at_home.cast("long")).alias("links"))
    asked = met.where("fate = 'search'").groupBy(*place, "core").agg(F.count(F.lit(1)).alias("asked"), F.max("held").alias("held"))
    tiles = checkpointed(asked.select(*place, "core", F.ceil(F.col("held") / tile).cast("int").alias("across"), F.ceil(F.col("asked") / tile).cast("int").alias("down")))
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    stored = indexed.join(beside(tiles), [*place, "core"]).select("row", *place, "core", "x", "codes", "missed", part("across", 1).alias("i"), F.explode(spread("down")).alias("j"))
    queries = met.where("fate = 'search'").join(beside(tiles), [*place, "core"]).select("row", *place, "core", "x", F.explode(spread("across")).alias("i"), part("down", 2).alias("j"))
    cell = [*place, "core", "i", "j"]
    stored = stored.toDF(*(f"_{c}" for c in stored.columns)).toDF(*stored.columns)  # columns of its own: both sides come from the index
    found = stored.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(_tile(sent, threshold, chord), "row long, other long, links long")
    found = checkpointed(found.unionByName(whole))

    links = found.where("links > 0").groupBy("row").agg(F.sum("links").alias("n_links"))
    roots = connected_components(found.where("other IS NOT NULL AND other <> row").select(F.col("row").alias("a"), F.col("other").alias("b")))
    named = rows.select("row", "vec_id").join(roots, F.col("row") == F.col("node"), "left").select("row", "vec_id", F.coalesce("root", "row").alias("root"))
    smallest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = named.join(smallest, "root").join(links, "row", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """WITH RECURSIVE x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(v, root) USING KEY (v) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT p.b, min(f.root) FROM r f JOIN p ON p.a = f.v JOIN recurring.r k ON k.v = p.b WHERE f.root < k.root GROUP BY p.b),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT r.v AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.root AS component_id, r.v = r.root AS kept FROM r LEFT JOIN n ON n.a = r.v"""
