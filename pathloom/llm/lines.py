"""Line dedup: lines that spread over many distinct sites are boilerplate and go, but for their first occurrence.

Every line's hash gets a HyperLogLog sketch of its sites; sketches merge by aggregation, also before the shuffle.
A line whose estimate is near the threshold gets its exact number of distinct sites. What decides is a hash of the
line (96 bits: xxhash64 and Murmur3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.batches import unused

MIN_SITES = 10
#: log2 of the sketch's registers; its relative error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 10


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, th (hash of the text), site, pos, h, c: one row per line that is not blank."""
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col)), F.lit("-"))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), site.alias("site"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    line = F.trim("line")
    return rows.where(F.length(line) > 0).select("id", "th", "site", "pos", F.xxhash64(line).alias("h"), F.hash(line).alias("c"))


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """h, c, first (the smallest (id, th, pos)): the lines of at least min_sites distinct sites."""
    sketched = lines.groupBy("h", "c").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("id", "th", "pos")).alias("first"))
    spread = sketched.select("h", "c", "first", F.hll_sketch_estimate("sketch").alias("n"))
    # Four standard errors around the threshold are near it.
    slack = 4 * 1.04 / (1 << lg_k) ** 0.5 * min_sites + 1
    sure = spread.where(F.col("n") > min_sites + slack).select("h", "c", "first")
    near = spread.where(F.col("n").between(min_sites - slack, min_sites + slack)).select("h", "c", "first")
    pairs = lines.select("h", "c", "site").distinct()
    exact = pairs.join(near.select("h", "c"), ["h", "c"], "left_semi").groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(near.join(exact.select("h", "c"), ["h", "c"], "left_semi"))


def _without(text: Column, drops: Column) -> Column:
    """text without the lines at the positions `drops`, in time linear in the lines."""
    return F.transform(
        F.array(F.split(text, "\n", -1)),
        lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drops), lambda i: F.get(parts, i)), "\n"),
    ).getItem(0)


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K, count_col: str | None = "lines_removed") -> DataFrame:
    """All rows and columns of docs with cleaned texts, plus `count_col`, the number of removed lines (long), unless that is None.

    A line is compared without spaces at its ends; blank lines stay. A line of min_sites sites or more stays only where
    it occurs first: in the smallest id (null first), there at its first position. A null site is a site of its own. A null text stays null.
    Rows alike in id and text are treated alike. A document of boilerplate alone ends with an empty text. docs may have any
    other columns; where one is named like count_col, the new column's name gets an underscore.
    """
    lines = _lines(docs, id_col, text_col, site_col)
    flagged = boilerplate_lines(lines, min_sites, lg_k).withColumnsRenamed({"h": "h2", "c": "c2"})
    # Occurrences meet the flagged hashes in an equi-join that AQE can broadcast by measured size or split where skewed.
    hits = lines.select("id", "th", "pos", "h", "c").join(flagged, (F.col("h") == F.col("h2")) & (F.col("c") == F.col("c2")))
    hits = hits.where(~F.struct("id", "th", "pos").eqNullSafe(F.col("first")))
    own, at_id, at_h, gone, said = unused(docs.columns, "_ld_h", "_ld_id", "_ld_th", "_ld_pos", count_col or "_")
    drops = hits.groupBy(F.col("id").alias(at_id), F.col("th").alias(at_h)).agg(F.collect_set("pos").alias(gone))
    met = docs.withColumn(own, F.xxhash64(text_col)).join(drops, F.col(id_col).eqNullSafe(F.col(at_id)) & (F.col(own) == F.col(at_h)), "left")
    met = met.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(gone))))
    counted = [F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(said)] if count_col else []
    return met.select(*docs.columns, *counted)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, source, pos, line, trim(line, ' ') AS t FROM l),
b AS (SELECT t, count(DISTINCT coalesce('s' || source, '-')) AS n FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT coalesce('s' || source, '-')) >= {MIN_SITES}),
o AS (SELECT k.doc_id, k.pos, k.line, b.t IS NOT NULL AS common,
        CASE WHEN b.t IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY k.t ORDER BY k.doc_id, k.pos) END AS nth
      FROM k LEFT JOIN b ON k.t = b.t),
c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE nth = 1) AS kept, count(*) FILTER (WHERE nth > 1) AS gone FROM o GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.kept, '') END AS text, d.lang, d.source, d.n_chars, coalesce(c.gone, 0)::BIGINT AS lines_removed
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id
"""
