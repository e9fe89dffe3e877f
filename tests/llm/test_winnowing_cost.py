"""What a unit costs, and that it is the same unit whatever it costs."""

import time

from pathloom.llm.winnowing import SPACED, UNIT, UNSPACED
from pyspark.sql import functions as F

SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
PLAIN = rf"[^\x20\x09-\x0D{SCRIPTS}]"
#: Units by a search among all scripts for each character.
PLAIN_UNIT = rf"[{SCRIPTS}]|(?<!{PLAIN}){PLAIN}{{1,16}}(?!{PLAIN})|{PLAIN}"


def _units(pattern):
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(0))


def test_units_of_texts_are_the_same(spark):
    texts = ["", " ", "a", "x" * 16, "x" * 17, "a\tb\x0bc\x0e\x1c\x85d", "語a語bb 語", "ไทย abc", "෿฀ก", "é" * 17 + " é", "\U00020000a\U0001f600 " + "z" * 40 + "語" + "y" * 16]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows.where(_units(UNIT) != _units(PLAIN_UNIT)).count() == 0


def test_every_character_is_of_the_same_class(spark):
    every = spark.range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF)).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert every.where(F.regexp_like("c", F.lit(f"^{SPACED}$")) != F.regexp_like("c", F.lit(f"^{PLAIN}$"))).count() == 0
    assert every.where(F.regexp_like("c", F.lit(f"^{UNSPACED}$")) != F.regexp_like("c", F.lit(f"^[{SCRIPTS}]$"))).count() == 0


def test_plain_text_costs_no_search_among_scripts(spark):
    rows = spark.range(8, numPartitions=1).select(F.repeat(F.lit("some words of many letters "), 20_000).alias("text")).localCheckpoint()

    def seconds(pattern):
        start = time.perf_counter()
        rows.agg(F.sum(F.size(_units(pattern)))).collect()
        return time.perf_counter() - start

    both = [(seconds(UNIT), seconds(PLAIN_UNIT)) for _ in range(4)]
    assert min(x for x, _ in both) < 0.75 * min(y for _, y in both)
