from pyspark.sql import functions as F

from pathloom.functions.ranking import buckets_for, dense_rank_in, ordered_rank, running_total


def test_ranks_and_totals(spark):
    rows = [(i, "a" if i % 3 else None, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, g string, n long")
    got = running_total(df, ["g"], F.xxhash64("i"), ["i"], F.col("n"), "before", 4).collect()
    for g in ("a", None):
        own = [r for r in got if r["g"] == g]
        at = 0
        for r in sorted(own, key=lambda r: (r["before"], r["before"] + r["n"])):
            assert r["before"] == at
            at += r["n"]
        ranks = dense_rank_in(df, ["g"], F.xxhash64("i"), ["i"], "k", 4).where(F.col("g").eqNullSafe(F.lit(g))).collect()
        assert sorted(r["k"] for r in ranks) == list(range(len(own)))
    done = ordered_rank(df, "i", ["n"], "k", run=16).collect()
    assert all(r["k"] == r["i"] for r in done)
    assert ordered_rank(df.where("false"), "i", [], "k").count() == 0


def test_a_key_with_most_rows_is_ranked_in_ranges(spark):
    far = [(7, i * i % 1009, 2**60 + i, i) for i in range(400)] + [(7, None, 5, -i) for i in range(30)]
    rows = far + [(k, k % 3, k, k) for k in range(60)] + [(5000 + k % 2, 1, -k, k) for k in range(90)] + [(k << 26, 0, 0, k) for k in range(5)]
    df = spark.createDataFrame(rows, "key long, a long, b long, x long")
    first = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])
    want = [(r[0], r[1], r[2]) for r in sorted(rows, key=first)]
    for most in (1 << 20, 100, 16):
        got = sorted(ordered_rank(df, "key", ["a", "b"], "k", run=64, most=most).collect(), key=lambda r: r["k"])
        assert [r["k"] for r in got] == list(range(len(rows)))
        assert [(r["key"], r["a"], r["b"]) for r in got] == want
    cells = ordered_rank(df, "key", ["a", "b"], "k", run=64, most=16)
    assert cells.columns == [*df.columns, "k"]
    # An order that is no whole number leaves a key whole; a null key comes first.
    text = df.select("key", "x", df["a"].cast("string").alias("s")).unionByName(spark.createDataFrame([(None, 1, "z")], "key long, x long, s string"))
    got = sorted(ordered_rank(text, "key", ["s", "x"], "k", run=64, most=16).collect(), key=lambda r: r["k"])
    assert [r["k"] for r in got] == list(range(len(rows) + 1)) and got[0]["key"] is None
    assert [(r["key"], r["s"]) for r in got] == sorted([(r["key"], r["s"]) for r in got], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_the_number_of_buckets_changes_nothing(spark):
    rows = spark.range(500).select("id", (F.col("id") % 2).alias("g"), F.xxhash64("id").alias("h"))
    found = [sorted(tuple(r) for r in running_total(rows, ["g"], F.col("h"), ["id"], F.col("id"), "t", n).select("id", "t").collect()) for n in (1, 2, 64)]
    want, sums = {}, {0: 0, 1: 0}
    for r in sorted(rows.collect(), key=lambda r: r["h"] % 2**64):
        want[r["id"]] = sums[r["g"]]
        sums[r["g"]] += r["id"]
    assert found[0] == found[1] == found[2] == sorted(want.items())
    assert [buckets_for(n) for n in (0, 1, 1 << 16, (1 << 16) + 1, 10**6)] == [1, 1, 1, 2, 16]
