"""Dense ranks and running sums without a window over one large group.

Rows of a group are dealt over hash buckets; each bucket is ranked by itself and the sums of the
earlier buckets are added. A group that holds most rows is spread over `buckets` window partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.lineage import checkpointed


def buckets_for(rows: int, each: int = 1 << 16) -> int:
    """How many buckets hold about `each` rows of a group of that many: a power of two, so parallelism grows with the group."""
    return 1 << min(20, max(0, -(-rows // each) - 1).bit_length())


def running_total(df: DataFrame, group: list[str], order_hash: Column, order: list[str], amount: Column, out: str, buckets: int, width: int = 64) -> DataFrame:
    """df with `out`: the sum of `amount` over the rows of the same group that come earlier.

    Rows come in the order of (order_hash, *order), the hash an unsigned number of `width` bits; its first bits are the bucket, so the
    number of buckets changes nothing. Rows that tie on all of these are interchangeable: they get distinct ranges in an unspecified
    order. Groups may be null (one group).
    """
    bits = (buckets - 1).bit_length()
    bucket = F.shiftrightunsigned("_oh", width - bits) if bits else F.lit(0).cast("long")
    # Within a bucket the sign is the same; a single bucket needs it turned.
    dealt = df.withColumn("_oh", order_hash).withColumn("_bk", bucket).withColumn("_am", amount.cast("long"))
    if not bits and width == 64:
        dealt = dealt.withColumn("_oh", F.col("_oh").bitwiseXOR(F.lit(-(1 << 63))))
    tail = Window.partitionBy(*group).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*group, "_bk").agg(F.sum("_am").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(tail), F.lit(0)))
    base = base.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bk").alias("_bk2"), "_base")
    same = F.col("_bk") == F.col("_bk2")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_bk").orderBy("_oh", *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_within", F.coalesce(F.sum("_am").over(within), F.lit(0)))
    return ranked.join(base, same).withColumn(out, F.col("_base") + F.col("_within")).drop("_oh", "_bk", "_am", "_bk2", "_base", "_within", *[f"_g{i}" for i in range(len(group))])


def dense_rank_in(df: DataFrame, group: list[str], order_hash: Column, order: list[str], out: str, buckets: int, width: int = 64) -> DataFrame:
    """df with `out`: 0, 1, 2, ... within each group, in the order of running_total."""
    return running_total(df, group, order_hash, order, F.lit(1), out, buckets, width)


def ordered_rank(df: DataFrame, key: str, order: list[str], out: str, run: int = 4096, most: int = 1 << 20) -> DataFrame:
    """df with `out`: 0, 1, 2, ... in the order of (key, *order). key is a long.

    Runs of `run` values are cells that are ranked by themselves; one row per cell gives the ranks that the cells begin at. A run of more
    than `most` rows has a cell for each of its keys, and for each range of the first column of order (if that is a whole number) where such a
    key has several: so a key with many rows is many tasks. Rows that tie get distinct ranks in an unspecified order. df is read once to
    size the runs, once for the result, and once more if a run is that large.
    """
    whole = bool(order) and dict(df.dtypes)[order[0]] in ("tinyint", "smallint", "int", "bigint")
    at = F.col(order[0]).cast("double") if whole else F.lit(None).cast("double")
    dealt = df.withColumn("_run", F.floor(F.col(key) / run))
    sizes = checkpointed(dealt.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi")))
    large = sizes.where(F.col("_n") > most)
    if large.isEmpty():
        cell, cells = ["_run"], sizes.select("_run", "_n")
    else:
        cell = ["_run", "_ck", "_cp"]
        # At most one row for each `most` rows of df.
        pieces = F.broadcast(large.select("_run", "_lo", "_hi", F.ceil(F.col("_n") / most).alias("_of")))
        # Casts to double, subtraction and scaling keep the order, so ranges do.
        range_of = F.when(F.col("_hi") > F.col("_lo"), F.least(F.col("_of") - 1, F.floor((at - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_of")))).otherwise(F.lit(0))
        # Nulls come first.
        range_of = F.when(at.isNull(), F.lit(-1)).otherwise(range_of)
        split = F.col("_of").isNotNull()
        dealt = dealt.join(pieces, "_run", "left").withColumn("_ck", F.when(split, F.col(key).cast("long")).otherwise(0)).withColumn("_cp", F.when(split, range_of).otherwise(0).cast("long")).drop("_lo", "_hi", "_of")
        cells = dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    before = lambda group, by, n: F.coalesce(F.sum(n).over(Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Sums over runs of runs, so that the one window over all sees a row for each run * run values.
    runs = sizes.select("_run", "_n", F.floor(F.col("_run") / run).alias("_block"))
    blocks = runs.groupBy("_block").agg(F.sum("_n").alias("_bn")).select(F.col("_block").alias("_b"), before([], ["_block"], "_bn").alias("_upto"))
    runs = runs.withColumn("_own", before(["_block"], ["_run"], "_n")).join(blocks, F.col("_block").eqNullSafe(F.col("_b"))).select(F.col("_run").alias("_r"), (F.col("_upto") + F.col("_own")).alias("_base"))
    if len(cell) > 1:
        cells = cells.withColumn("_in", before(["_run"], cell[1:], "_n")).join(runs, F.col("_run").eqNullSafe(F.col("_r"))).select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(cell)], (F.col("_base") + F.col("_in")).alias("_base"))
    else:
        cells = runs.withColumnRenamed("_r", "_at0")
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy(key, *order))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(cell)])
    return dealt.withColumn("_nth", nth).join(cells, same).withColumn(out, F.col("_base") + F.col("_nth") - 1).drop("_nth", "_base", *cell, *[f"_at{i}" for i in range(len(cell))])
