"""Fingerprints of short texts and of texts without blanks."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm import winnowing


@pytest.mark.parametrize("between", ["", "x", "a b c d e", "日本語の文章です"])
def test_short_and_unspaced_texts_share_hashes_with_their_edited_copies(spark, between):
    r = random.Random(8)
    han, word = "日本語文章検索東京大学私行来", lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    said = ["word", "two words", "日本語文章", "z" * 17, "\U0001f600" * 9]
    said += ["".join(r.choice(han) for _ in range(n)) for n in (8, 40, 127, 128, 200, 3000)]
    said += [word(n) for n in (20, 24, 127, 128, 150, 3000)]
    said += [" ".join(word(r.randrange(1, 17)) for _ in range(n)) for n in range(1, 60)] + [" ".join(word(16) for _ in range(n)) for n in range(1, 30)]
    said = [t for t in said if len(t) >= 4]
    rows = [(2 * i + k, t if k else between) for i, t in enumerate(said) for k in (0, 1)]
    found = winnowing.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 1")
    bad = found.where("near_edited = 0").select("doc_id", "n_chars").collect()
    assert not bad, [(r["n_chars"], said[r["doc_id"] // 2][:40]) for r in bad]


def test_windows_of_unlike_lengths_meet(spark):
    r = random.Random(9)
    shared = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(12))
    texts = spark.createDataFrame([(shared,), (" ".join([shared] + [f"w{i}" for i in range(400)]),)], "t string")
    a, b = (set(x["h"]) for x in texts.select(winnowing.hashes(winnowing.fingerprint(F.col("t"))).alias("h")).collect())
    assert a & b
