"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within `radius` 3 bits of each other agree but for at most one bit in one of their two 32-bit words.
Half of the radius, rounded down, is one bit: every fingerprint emits each of its words and all variants of it within
one bit. Variants collide in a shuffle; collisions between a word and a variant (or a word and the same word) are the
candidates, and their 64 bits verify them. Of a word's variants only those that set a clear bit are emitted: where two
words differ in one bit, one of them has it clear, so every pair still meets. Where many have a word in common, the other words are
hashed into balls in turn. Equal fingerprints are one node.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.batches import bound_batches, unused
from pathloom.functions.lineage import checkpointed
from pathloom.llm.components import connected_components

RADIUS = 3
STEP = 1 << 15
#: Fingerprints with the same half that are compared in pairs.
CROWD = 128


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text as an unsigned 64-bit number; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    total = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, total, STEP):
        part = words[at : at + STEP + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long), th (hash of the text, null for a null text): one row per row of docs."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), b.column("th")], names=["doc_id", "fp", "th"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("th"))
    return rows.mapInArrow(run, "doc_id long, fp long, th long")


def _masks(bits: int) -> list[int]:
    """All 32-bit numbers with at most `bits` ones."""
    return [sum(1 << i for i in ones) for n in range(bits + 1) for ones in combinations(range(32), n)]


def _ball(word, bits: int):
    """All variants of a 32-bit word within `bits` bits."""
    return F.transform(F.array(*[F.lit(m).cast("long") for m in _masks(bits)]), lambda m: word.bitwiseXOR(m))


def _halves(nodes: DataFrame) -> DataFrame:
    """fp, w, word (that half of it), other (the other half): two rows a fingerprint."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    both = F.array(F.struct(F.lit(0).alias("w"), low.alias("word"), high.alias("other")), F.struct(F.lit(1).alias("w"), high.alias("word"), low.alias("other")))
    return nodes.select("fp", F.inline(both))


def _near(own: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs within the radius that share a half, or of which one has a half that the other has but for one more set bit."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("word").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0)
    off = own.select(F.col("fp").alias("fp2"), F.col("w").alias("w2"), "word", F.explode(bits).alias("bit"))
    off = off.select("fp2", "w2", F.col("word").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("word2"))
    same = own.select(F.col("fp").alias("fp2"), F.col("w").alias("w2"), F.col("word").alias("word2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    meet = (F.col("w") == F.col("w2")) & (F.col("word") == F.col("word2"))
    pairs = own.join(same.hint("merge"), meet & (F.col("fp") < F.col("fp2")) & near).select("fp", "fp2").unionByName(own.join(off.hint("merge"), meet & near).select("fp", "fp2"))
    return pairs.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"))


def _stars(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(a, b): of each key the fingerprints of both tables(w, word, v, fp) with the smallest one of the inner table; keys without an inner one link nothing."""
    both = inner.withColumn("inside", F.col("fp")).unionByName(outer.withColumn("inside", F.lit(None).cast("long")))
    hub = F.min("inside").over(Window.partitionBy("w", "word", "v"))
    return both.withColumn("hub", hub).where("hub <> fp").select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b"))


def linked_pairs(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """nodes(fp), distinct -> (a, b): pairs of fingerprints that differ in 1 to `radius` bits; whoever is linked is connected.

    Up to `crowd` fingerprints with the same half, every pair comes once. In a crowd with a half in common, the other halves meet in the middle
    in turn: each emits its variants within half of what is left of the radius, rounded down and up, and all that share a variant
    are tied to one of them. So a crowd makes rows in proportion to its size, and no link between components is lost.
    Joins have the merge hint: their sides grow with the input, and a side of a few MB in a shuffle may be a hundred in the driver that broadcasts it.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two words and one flipped bit cover a radius of 3 at most")
    halves = _halves(nodes)
    sizes = halves.groupBy("w", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select(F.col("w").alias("cw"), F.col("word").alias("cword"))
    sizes = checkpointed(sizes)
    if sizes.isEmpty():
        return _near(halves, radius).distinct()
    in_crowd = lambda rows: rows.join(sizes.hint("merge"), (F.col("w") == F.col("cw")) & (F.col("word") == F.col("cword")), "left_semi")
    members = checkpointed(in_crowd(halves))
    # Pairs by halves, but for those that a crowd answers for.
    calm = halves.join(sizes.hint("merge"), (F.col("w") == F.col("cw")) & (F.col("word") == F.col("cword")), "left_anti")
    pairs = _near(calm, radius)
    lower, upper = radius // 2, radius - radius // 2
    within = lambda rows, bits: rows.select("w", "word", "fp", F.explode(_ball(F.col("other"), bits)).alias("v"))
    stars = [_stars(within(members, lower), within(members, upper))]
    if radius:
        # One bit of the crowd's half apart, on either side: what is left of the radius lies in the other half.
        left = radius - 1
        around = halves.select("fp", "w", "other", F.explode(F.transform(F.array(*[F.lit(1 << i).cast("long") for i in range(32)]), lambda m: F.col("word").bitwiseXOR(m))).alias("word"))
        stars.append(_stars(within(members, left // 2), within(in_crowd(around), left - left // 2)))
    for found in stars:
        pairs = pairs.unionByName(found)
    return pairs.distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp, th, root (the component's smallest fingerprint), component_id (the smallest id reachable over links, itself included). One row per row of docs.

    Fingerprints link at `radius` or fewer differing bits. Texts without words (null, empty, blank) have fingerprint 0 and are
    linked like any other. A null id is no candidate for the smallest; a component of null ids alone has a null id.
    Repeated rows each get a row. An empty table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(linked_pairs(nodes.select("fp"), radius))
    named = nodes.join(roots.hint("merge"), nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(smallest.hint("merge"), "root").select(F.col("fp").alias("fp2"), "root", "component_id")
    return rows.join(found.hint("merge"), rows["fp"] == found["fp2"]).select("doc_id", "fp", "th", "root", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows and columns of docs, one of each root of found(doc_id, th, root): the smallest (id, hash of the text). Rows with a null id stay as they are.

    Other columns of docs may have any names.
    """
    h, kept_id, kept_h, n = unused(docs.columns, "_nd_h", "_nd_id", "_nd_th", "_nd_n")
    keep = found.where(F.col("doc_id").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("k")).select(F.col("k.doc_id").alias(kept_id), F.col("k.th").alias(kept_h))
    marked = docs.withColumn(h, F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)))
    stay = marked.join(keep.hint("merge"), (F.col(id_col).cast("long") == F.col(kept_id)) & F.col(h).eqNullSafe(F.col(kept_h)))
    # Repeated rows of the representative are copies too; other texts with its id are not.
    nth = F.row_number().over(Window.partitionBy(kept_id, kept_h).orderBy(*[F.col(c) for c in docs.columns if c != text_col]))
    one = stay.withColumn(n, nth).where(F.col(n) == 1)
    return one.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, one of each component of near_duplicates."""
    return one_of_each(docs, near_duplicates(docs, radius, id_col, text_col), id_col, text_col)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
