"""A filter over keys of bounded size: rows whose key is surely not among some others stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27
#: Bits of one row's bitmap, as bitmap_construct_agg makes it.
WIDE = 1 << 15


def bits_for(keys: int) -> int:
    """Bits of places for so many keys: 16 places a key, up to 2 ** BITS places however many keys there are."""
    return min(BITS, max(16, (16 * keys).bit_length()))


def key_filter(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """_fb, _fm: bitmaps of a hash's places among 2 ** bits. At most 2 ** (bits - 15) rows of 4 KB, however many keys: 16 MB for 27 bits."""
    at = F.pmod(key, F.lit(1 << bits))
    return keys.select(F.floor(at / WIDE).cast("int").alias("_fb"), (at % WIDE).alias("_bit")).groupBy("_fb").agg(F.bitmap_construct_agg("_bit").alias("_fm"))


def among(rows: DataFrame, key: Column, bitmaps: DataFrame, out: str, bits: int = BITS) -> DataFrame:
    """rows with `out`: false where the key is surely not among those of the filter. key must be a hash and the same expression of both."""
    at = F.pmod(key, F.lit(1 << bits))
    placed = rows.withColumn("_fa", at)
    met = placed.join(F.broadcast(bitmaps), F.floor(F.col("_fa") / WIDE).cast("int") == F.col("_fb"), "left")
    bit = (F.col("_fa") % WIDE).cast("int")
    byte = F.conv(F.hex(F.call_function("substring", F.col("_fm"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, bit % 8) == 1
    return met.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_fa", "_fb", "_fm")
