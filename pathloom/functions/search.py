"""Finding a value's place among sorted bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def place(value: Column, bounds: list[int], or_equal: bool = True) -> Column:
    """How many bounds are at most (or, else, below) the value, an int, by binary search. Null values give null."""
    if not bounds:
        return F.when(value.isNotNull(), F.lit(0))
    cut = F.array(*[F.lit(b).cast("long") for b in bounds])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(cut, mid) <= value if or_equal else F.get(cut, mid) < value
        return F.when(s["lo"] >= s["hi"], s).when(right, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, step, lambda s: s["lo"])
    return F.when(value.isNotNull(), found)
