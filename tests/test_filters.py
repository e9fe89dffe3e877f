from pyspark.sql import functions as F

from pathloom.functions.filters import among, bits_for, key_filter


def test_no_key_is_lost_and_few_others_pass(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    some = rows.where("id % 50 = 7")
    found = among(rows, F.col("h"), key_filter(some, F.col("h")), "in")
    assert found.columns == ["id", "h", "in"] and found.where("id % 50 = 7 AND NOT in").count() == 0
    assert found.count() == 20_000 and found.where("in").count() < 420
    assert among(rows, F.col("h"), key_filter(some.where("false"), F.col("h")), "in").where("in").count() == 0
    assert [bits_for(n) for n in (0, 10**4, 10**12)] == [16, 18, 27]
    tight = among(rows, F.col("h"), key_filter(some, F.col("h"), 16), "in", 16)
    assert tight.where("id % 50 = 7 AND NOT in").count() == 0 and tight.where("in").count() < 2000
