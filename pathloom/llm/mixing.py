"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a fixed shuffled order, form a stream of words that may be read twice; the stream is
cut into blocks of equal length. Slot t of the schedule is the golden-ratio point frac((t + 1) * phi): the source
whose interval of cumulative target shares holds the point gets the slot. A source's slots, ranked, take its
blocks in order, and what its slots do not reach is not taken. So every stretch of the schedule is close to the target shares, and a
source's total is off by the points' discrepancy, a few blocks. Slots for which a stream has no words left stay empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.batches import unused
from pathloom.functions.lineage import checkpointed
from pathloom.functions.ranking import buckets_for, dense_rank_in, running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
GOLDEN = 0.6180339887498949
#: Slots of a schedule, about: a total is off by a few of so many parts. More, where there are many sources.
SLOTS = 1 << 20
SOURCE_SLOTS = 64
#: Words of a block at most.
BLOCK = 256
#: Slots that share a file.
STRETCH = 1 << 14
GRID = 1 << 12
#: Sources whose table is broadcast.
FEW_SOURCES = 50_000


def word_count(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """Sixty bits of a digest of id and text: the shuffled place of a row within its source."""
    said = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size long, source_no int, target double: shares by weight, no target above `most` times its source.

    One row per source. The weights repeat over the sources in code point order, null last. The excess of a stopped
    source goes to the others by weight until none is above: target = min(most * size, level * weight), with the
    level found from running sums in the order of size / weight. Windows here see one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("source_no", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("stop") / F.col("weight"), "source_no")
    whole = Window.partitionBy(F.lit(1))
    per = per.withColumn("_stopped", F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("_open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("_level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.col("_stopped")) / F.col("_open"))
    level = F.min(F.when(F.col("stop") / F.col("weight") > F.col("_level"), F.struct((F.col("stop") / F.col("weight")).alias("r"), "source_no", "_level"))).over(whole)
    return per.withColumn("target", F.coalesce(F.least("stop", level["_level"] * F.col("weight")), F.col("stop"))).select("source", "source_size", "source_no", "target")


def block_words(targets: DataFrame) -> int:
    """Words of a block: SLOTS blocks make the mix, or SOURCE_SLOTS for each source if these are more; 1 to BLOCK."""
    all_of = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("words"), F.count(F.lit(1)).alias("sources")).first()
    return min(BLOCK, max(1, int(all_of["words"] // max(SLOTS, SOURCE_SLOTS * all_of["sources"]))))


def schedule(targets: DataFrame, block: int, grid: int = GRID, golden: float = GOLDEN) -> DataFrame:
    """slot long, source_no, number long (of the source's block): the mix, block by block. number is 0, 1, ... within a source.

    The cumulative shares are an interval for each source; intervals and points meet on a grid of cells, so this is
    an equi-join. There are as many slots as blocks in all targets.
    """
    spark = targets.sparkSession
    per = targets.select("source_no", F.round("target").cast("long").alias("quota")).where("quota > 0")
    up = Window.orderBy("source_no")  # a row per source
    per = per.withColumn("all", F.sum("quota").over(Window.partitionBy(F.lit(1)))).withColumn("hi", F.sum("quota").over(up)).withColumn("lo", F.col("hi") - F.col("quota"))
    cells = F.explode(F.sequence(F.floor(F.col("lo") / F.col("all") * grid), F.least(F.floor(F.col("hi") / F.col("all") * grid), F.lit(grid - 1))))
    spans = per.select("source_no", (F.col("lo") / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"), cells.alias("cell"))
    count = -(-per.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"] // block)
    slots = spark.range(count).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(golden)).alias("x")).withColumn("u", F.col("x") - F.floor("x"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * grid))
    drawn = slots.join(spans, "cell").where("u >= lo AND u < hi").select("slot", "source_no")
    return dense_rank_in(drawn, ["source_no"], F.col("slot"), [], "number", buckets_for(count), width=max(1, (count - 1).bit_length()))


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed, reads). placed: a row per row of docs with doc_id, size, source_size, source_no, target, row_key and start, its place in its source's stream.
    reads: source_no, start, row_key, size, read (0, 1, ...), slot (of the block in which this read begins), words (that it gives to the mix, at least one).

    A null text has no words. A null source is a source. Rows alike in id and text are interchangeable and each has
    its own place in the stream. Other columns of docs are not read.
    """
    # Small rows, cut here: the texts are read once.
    sized = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), row_key(F.col(id_col), F.col(text_col)).alias("row_key")))
    targets = checkpointed(source_targets(sized, share, most, weights))
    block = block or block_words(targets)
    plan = checkpointed(schedule(targets, block))
    placed = running_total(sized, ["source"], F.col("row_key"), ["doc_id", "size"], F.col("size"), "start", buckets_for(sized.count()), width=60)
    got = plan.groupBy(F.col("source_no").alias("_no")).agg((F.count(F.lit(1)) * block).alias("_got"))
    limit = F.least(F.coalesce("_got", F.lit(0)), F.floor(F.col("source_size") * F.lit(float(most)))).cast("long")
    known = targets.join(got, F.col("source_no") == F.col("_no"), "left").select(F.col("source").alias("_s"), "source_size", "source_no", "target", limit.alias("_limit"))
    # A hot source must not meet its row in one task: the table of sources is broadcast where it is small by count.
    known = F.broadcast(known) if targets.count() <= FEW_SOURCES else known
    placed = checkpointed(placed.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    again = F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil(most) - 1))))
    reads = placed.where("size > 0").select("source_no", "start", "row_key", "size", "source_size", "_limit", again.alias("read")).withColumn("a", F.col("read") * F.col("source_size") + F.col("start"))
    reads = reads.where(F.col("a") < F.col("_limit")).withColumn("words", F.least("size", F.col("_limit") - F.col("a"))).withColumn("number", F.floor(F.col("a") / block))
    met = reads.join(plan, ["source_no", "number"])
    return placed.drop("_limit"), met.select("source_no", "start", "row_key", "size", "read", "slot", "words")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), slot (where it first comes, or null).

    Options and the rest are those of placements. Each source's words in the mix come near its target. No source is read more than `most` times, so no
    document is taken more than `most` times its size. The shuffle is a hash of id and text (row_key): reruns agree. An empty table gives no rows.
    """
    placed, reads = placements(docs, **options)
    taken = reads.groupBy(F.col("source_no").alias("_no"), F.col("start").alias("_st")).agg(F.sum("words").alias("_taken"), F.min("slot").alias("slot"))
    # (source_no, start) is unique among rows with words.
    out = placed.join(taken, (F.col("source_no") == F.col("_no")) & (F.col("start") == F.col("_st")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "slot")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows and columns of docs, each as often as the mix takes it, near each other in a file where the schedule has them near each other, in its order.

    A read of a document counts if the mix takes half of its words or more, so a source's words come within half a document of what its
    slots hold. Other columns of docs may have any names. Rows alike in id and text are taken alike.
    """
    key, read, slot, words, part = unused(docs.columns, "_mx_key", "_mx_read", "_mx_slot", "_mx_words", "_mx_part")
    _, reads = placements(docs, id_col, text_col, **options)
    whole = reads.where(F.col("words") * 2 >= F.col("size")).groupBy(F.col("row_key").alias(key), F.col("read").alias(read)).agg(F.min("slot").alias(slot))
    keyed = docs.withColumn(words, row_key(F.col(id_col), F.col(text_col)))
    met = keyed.join(whole, F.col(words) == F.col(key)).withColumn(part, F.floor(F.col(slot) / STRETCH))
    return met.repartition(part).sortWithinPartitions(slot, key, read).select(*docs.columns)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("slot", F.coalesce("slot", F.lit(-1)))


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS stop FROM s),
r AS (SELECT *, coalesce(sum(stop) OVER (ORDER BY stop / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(weight) OVER (ORDER BY stop / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total * 1.5::DOUBLE - stopped) / open AS level FROM r),
v AS (SELECT level AS lv FROM l WHERE stop / weight > level ORDER BY stop / weight, no LIMIT 1),
t AS (SELECT source, no, source_size, coalesce(least(stop, (SELECT lv FROM v) * weight), stop) AS target FROM l),
b AS (SELECT least({BLOCK}, greatest(1, floor(sum(target) / greatest({SLOTS}, {SOURCE_SLOTS} * count(*)))))::BIGINT AS words FROM t),
q AS (SELECT no, quota, sum(quota) OVER (ORDER BY no)::BIGINT AS hi, sum(quota) OVER ()::BIGINT AS whole FROM (SELECT no, round(target)::BIGINT AS quota FROM t) WHERE quota > 0),
i AS (SELECT no, (hi - quota)::DOUBLE / whole::DOUBLE AS lo, hi::DOUBLE / whole::DOUBLE AS hi FROM q),
n AS (SELECT unnest(range((SELECT (max(whole) + (SELECT words FROM b) - 1) // (SELECT words FROM b) FROM q))) AS slot),
u AS (SELECT slot, (slot + 1) * {GOLDEN!r}::DOUBLE AS x FROM n),
p AS (SELECT slot, i.no, row_number() OVER (PARTITION BY i.no ORDER BY slot) - 1 AS number FROM u JOIN i ON x - floor(x) >= i.lo AND x - floor(x) < i.hi),
g AS (SELECT no, count(*) * (SELECT words FROM b) AS got FROM p GROUP BY no),
a AS (SELECT doc_id, d.source, size, t.no, t.source_size, t.target, least(coalesce(g.got, 0), 2 * t.source_size) AS lim,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON g.no = t.no)
SELECT a.doc_id, a.size, a.source_size, a.target,
       (greatest(0, least(lim, start + size) - start) + greatest(0, least(lim, source_size + start + size) - (source_size + start)))::BIGINT AS taken,
       coalesce(CASE WHEN size > 0 AND start < lim THEN p.slot END, -1)::BIGINT AS slot
FROM a LEFT JOIN p ON p.no = a.no AND p.number = a.start // (SELECT words FROM b)
"""
