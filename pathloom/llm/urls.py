"""URL filters as a sort-merge range join.

A rule (host, path) is the prefix `reversed host labels + path`, an interval of canonical keys. A URL has one key for
each of its parent domains, as far up as rules go: reversed labels of that domain + path. Prefix intervals nest or are apart,
so one sweep over rules and keys in sorted order, with a stack of the rules that are still open, finds for every
key the longest rule that covers it. The sweep streams; it holds the stack alone.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.batches import bound_batches, unused

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _sweep(batches):
    """Sorted rows (bucket, key, kind, verdict, rule, url) -> (url, rule, verdict) for the URLs that a rule covers."""
    bucket, stack = None, []
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("bucket", "key", "kind", "verdict", "rule", "url")]
        urls, rules, verdicts = [], [], []
        for at, key, kind, verdict, rule, url in zip(*cols, strict=True):
            if at != bucket:
                bucket, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict))
            elif stack:
                urls.append(url)
                rules.append(stack[-1][1])
                verdicts.append(stack[-1][2])
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["url", "rule", "verdict"])


def reversed_labels(host):
    return F.reverse(F.split(host, r"\.", -1))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of pages, plus host, path, rule (host + path, or null) and verdict; where pages has such a column, the new one's name gets an underscore.

    rules(verdict, host, path): path starts with a slash. The longest fitting rule wins, by the length of host + path, then
    of the host, then the rule that sorts last. A null url, or one without "://", has an empty host and path and the
    default verdict. Each distinct URL is judged once. Rules are repeated for every bucket of URLs, so they move
    as often as there are shuffle partitions; they are streamed, never held. Of equal rules the largest verdict wins.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    host_out, path_out, rule_out, verdict_out, asked, found = unused(pages.columns, "host", "path", "rule", "verdict", "_uf_u", "_uf_url")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host = F.translate(F.regexp_extract(F.col("url"), AFTER, 1), UPPER, LOWER)
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0
    urls = pages.select(F.col(url_col).alias("url")).distinct().where(F.col("url").isNotNull())
    parts = urls.select("url", reversed_labels(host).alias("labels"), host.alias("host"), F.regexp_extract("url", AFTER, 2).alias("path")).where("host <> '' AND path <> ''")
    depth = F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(deepest, 1)))))
    keys = parts.select("url", "labels", "path", depth.alias("d")).select(
        F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int").alias("bucket"),
        F.concat(F.array_join(F.slice("labels", 1, F.col("d")), "."), "path").alias("key"),
        F.lit(1).alias("kind"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"), "url",
    )
    opened = rules.select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"),
        F.concat(F.array_join(reversed_labels(F.col("host")), "."), "path").alias("key"),
        F.lit(0).alias("kind"), "verdict", F.concat("host", "path").alias("rule"), F.lit(None).cast("string").alias("url"),
    )
    sorted_rows = keys.unionByName(opened).repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", "kind")
    hits = sorted_rows.mapInArrow(_sweep, "url string, rule string, verdict string")
    longest = F.max(F.struct(F.length("rule"), F.instr("rule", "/"), "rule", "verdict")).alias("w")
    won = hits.groupBy(F.col("url").alias(found)).agg(longest).select(found, F.col("w.rule").alias(rule_out), F.col("w.verdict").alias(verdict_out))
    met = pages.withColumn(asked, F.col(url_col)).join(won, F.col(asked) == F.col(found), "left")
    own = F.translate(F.regexp_extract(F.col(asked), AFTER, 1), UPPER, LOWER)
    return met.select(
        *pages.columns,
        F.coalesce(own, F.lit("")).alias(host_out), F.coalesce(F.regexp_extract(asked, AFTER, 2), F.lit("")).alias(path_out),
        rule_out, F.coalesce(verdict_out, F.lit(default)).alias(verdict_out),
    )


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    found = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS host0, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
k AS (SELECT page_id, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
m AS (SELECT *, '.' || host AS dotted FROM k),
r AS (SELECT *, CASE
    WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with(dotted, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with(dotted, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM m)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
