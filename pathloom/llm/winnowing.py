"""Document fingerprints by winnowing, in DataFrame functions alone.

Words are hashed once and every k consecutive word hashes make a k-gram hash. Of every window of w grams the smallest hash
is chosen, the rightmost where it ties, and kept with its position. Texts that share a run of w + k - 1 words share a chosen hash.

A character of a script without blanks counts as a word, and so does each of a run too long for a word. Short texts have smaller
windows: what a large window chooses, the smaller ones inside it choose too, so texts of unlike lengths still share hashes.
Texts of under SHORT characters are winnowed over characters as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GRAM = 3
WINDOW = 10
#: Scripts that put no blanks between words. None has a character below U+0E00, so those are told by one comparison; a script is a search among all scripts.
SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
LOW = r"\x00-\x{DFF}"
UNSPACED = rf"[[^{LOW}]&&[{SCRIPTS}]]"
SPACED = rf"[[\x21-\x{{DFF}}\x00-\x08\x0E-\x1F][^{LOW}{SCRIPTS}]]"
#: A run of at most 16 characters is a word; in a longer one, and in scripts without blanks, every character is.
UNIT = rf"(?<!{SPACED}){SPACED}{{1,16}}+(?!{SPACED})|{SPACED}|{UNSPACED}"
#: Texts of fewer characters are winnowed over characters too.
SHORT = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def _chosen(grams: Column, window: Column, most: int) -> Column:
    """Of every window of grams (struct<h, p>) the least, each once. A window has at most `most` grams.

    Least ones of 1, 2, 4, ... grams and at last of the window's are made of two shorter windows each; the right one counts where they tie.
    """

    def joined(m: Column, by: Column) -> Column:
        n = F.size(m) - by
        return F.zip_with(F.slice(m, 1, n), F.slice(m, by + 1, n), lambda x, y: F.when(x["h"] < y["h"], x).otherwise(y))

    def widened(m: Column, w: Column, wide: int) -> Column:
        if wide >= most:
            return m
        return _let(F.when(w > wide, joined(m, F.least(F.lit(wide), w - wide))).otherwise(m), lambda x: widened(x, w, 2 * wide))

    picks = _let(grams, lambda g: _let(F.least(window, F.size(g)), lambda w: widened(g, w, 1)))
    # Windows slide, so equal picks are neighbours.
    return _let(picks, lambda ps: F.filter(ps, lambda x, i: (i == 0) | (x["p"] != F.get(ps, i - 1)["p"])))


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<struct<h long, p int>>: chosen gram hashes in the order of the text; p is minus the gram's position.

    Fewer than `gram` words are one gram, fewer than the window's grams one window. The window is whole from 32 * (window + 2) characters
    on; below, two thirds of a text in words of 16 characters still hold one. No words: an empty array.
    """
    hashed = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda x: F.xxhash64(x))
    grams = _let(hashed, lambda hs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(hs) - gram, F.lit(0))), lambda i: F.struct(F.xxhash64(*[F.get(hs, i + d) for d in range(gram)]).alias("h"), (-i).alias("p"))))
    room = F.least(F.lit(window), F.greatest(F.lit(1), F.floor(F.char_length(text) / 32).cast("int") - 2))
    chosen = _let(room, lambda w: _chosen(grams, w, window))
    return F.when(F.regexp_like(text, F.lit(WORD)), chosen).otherwise(F.slice(chosen, 1, 0))


def winnow_characters(text: Column, gram: int = 3, window: int = 4) -> Column:
    """winnow over the characters of a text of fewer than SHORT; longer texts and those without words have an empty array."""
    n = F.char_length(text)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - gram, F.lit(0))), lambda i: F.struct(F.xxhash64(F.lit("characters"), F.substring(text, i + 1, F.lit(gram))).alias("h"), (-i).alias("p")))
    room = F.least(F.lit(window), F.greatest(F.lit(1), F.floor(n / 2).cast("int") - 1))
    chosen = _let(room, lambda w: _chosen(grams, w, window))
    return F.when((n < SHORT) & F.regexp_like(text, F.lit(WORD)), chosen).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """winnow and, after it, winnow_characters."""
    return F.concat(winnow(text, gram, window), winnow_characters(text))


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: x["h"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 for two empty ones."""
    return _let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def readable(chosen: Column) -> Column:
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.hex(x["h"])), F.lit("@"), (-x["p"]).cast("string"))), " ")


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds are below the value, by binary search; null: -1."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    cut = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(F.get(cut, mid) < value, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length() + 1))), start, step, lambda s: s["lo"])
    return F.when(value.isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """doc_id, text, b, ghost, and the window in which lead() is the next row by descending id, after the last the first.

    Ids are dealt into ranges by approximate quantiles, so a range is one sorted run. The first rows of a range are repeated as
    ghosts at the end of the range before it (the very first at the end of the last one). The driver holds two numbers per range. Ties on
    id go by a hash of the text; null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 20 * buckets).alias("q")).first()["q"] if shares else None
    rows = rows.withColumn("b", _bucket(F.col("doc_id"), sorted(set(bounds or []))))
    heads = sorted(((r["b"], r["h"]) for r in rows.groupBy("b").agg(F.max("doc_id").alias("h")).collect()), key=lambda x: -x[0])
    before = [(b, heads[i - 1][0], h) for i, (b, h) in enumerate(heads)]
    # One row per range.
    firsts = spark.createDataFrame(before, "own int, earlier int, head long")
    met = rows.join(F.broadcast(firsts), F.col("b") == F.col("own"))
    here = F.struct(F.col("b").alias("b"), F.lit(0).alias("ghost"))
    there = F.struct(F.col("earlier").alias("b"), F.lit(1).alias("ghost"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(here, there)).otherwise(F.array(here))
    dealt = met.select("doc_id", "text", F.explode(copies).alias("at")).select("doc_id", "text", "at.b", "at.ghost", F.xxhash64("text").alias("th"))
    return dealt, Window.partitionBy("b").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "th")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited, chosen, edited_chosen (arrays of fingerprint), near_edited, near_next for every row of docs.

    The edited text replaces the last third of the code points by the first as many of the next document (descending id, after the
    last the first; all, if it is shorter). A null text is an empty one. A single document is its own next one. Texts move once.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, order = with_next(docs, buckets, id_col, text_col)
    third = F.floor(F.char_length("text") / 3).cast("int")
    both = dealt.withColumn("after", F.lead("text").over(order)).withColumn("n", F.char_length("text"))
    both = both.withColumn("edited", F.concat(F.left("text", F.col("n") - third), F.left(F.coalesce("after", F.lit("")), third)))
    found = both.withColumn("chosen", fingerprint(F.col("text"), gram, window)).withColumn("own", hashes(F.col("chosen")))
    found = found.withColumn("following", F.lead("own").over(order)).where("ghost = 0")
    found = found.withColumn("edited_chosen", fingerprint(F.col("edited"), gram, window))
    return found.select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited", "chosen", "edited_chosen", likeness(F.col("own"), hashes(F.col("edited_chosen"))).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))


def op6_winnowing(spark, sf_dir: str) -> DataFrame:
    found = fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), readable(F.col("chosen")).alias("fingerprint"), readable(F.col("edited_chosen")).alias("edited_fingerprint"), "near_edited", "near_next")
