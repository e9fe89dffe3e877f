"""Small documents with every awkward case, and what reads them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=0, n=30):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta", "Éé", "zug", "über", "x", "the", "naïve", "日本", "\U0001f600"]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) + "\n" + r.choice(["Common line", "rare %d" % i]) for i in range(n)]
    base += [base[0], base[0], base[1] + " more", None, "", "   \n\t ", "a", "word " * 4000, "z" * 3000, "Common line", "Common line\nCommon line\nown"]
    return base


def documents(spark, seed=0, extra=False):
    said = texts(seed)
    sources = [None, "s1", "s2", "a,b", "Z", "é", "", "s8", "s9", "s10", "s11", "s12"]
    rows = [(i, t, None if i % 7 == 0 else "en" if i % 2 else "fr", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(said)]
    rows += [rows[3], (None, "no id", "en", None, 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "doc_id AS shard", "text AS score", "1 AS h", "source AS pos") if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
