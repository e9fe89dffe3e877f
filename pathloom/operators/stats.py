"""Statistics of graphs and of solves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.graph import out_degrees


def degree_stats(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """avg_degree, max_degree, dev_degree (population) over all vertices, isolated ones too."""
    return out_degrees(edges, vertices).agg(F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.stddev_pop("degree").alias("dev_degree"))


def weight_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.avg("weight").alias("avg_weight"), F.max("weight").alias("max_weight"), F.stddev_pop("weight").alias("dev_weight"))


def graph_stats(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: vertices, edges, degree and weight statistics, and a null diameter (it is never estimated)."""
    counts = vertices.agg(F.count(F.lit(1)).alias("vertices")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    return counts.crossJoin(degree_stats(edges, vertices)).crossJoin(weight_stats(edges)).withColumn("diameter", F.lit(None).cast("long"))


def sampled_weight(edges: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return edges.sample(fraction=fraction, seed=seed).agg(F.avg("weight").alias("avg_weight"))


def stride_sample(edges: DataFrame, stride: int, seed: int = 0) -> DataFrame:
    """Edges whose hash of (src, dst) is 0 modulo stride: about one in `stride`, the same ones on every run and however the table is dealt."""
    return edges.where(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "src", "dst")), 1, 8), 16, 10).cast("long") % stride == 0)


def weight_estimate(edges: DataFrame, stride: int, seed: int = 0, z: float = 2.58) -> DataFrame:
    """sampled, avg_weight, error of a stride sample: the mean of all weights lies within error of avg_weight with the confidence that z stands for (99 of 100), as the
    sample's mean is about normal. error is null for samples of fewer than two edges."""
    return stride_sample(edges, stride, seed).agg(F.count(F.lit(1)).alias("sampled"), F.avg("weight").alias("avg_weight"), (F.lit(z) * F.try_divide(F.stddev_samp("weight"), F.sqrt(F.count(F.lit(1))))).alias("error"))


def degree_histogram(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return out_degrees(edges, vertices).groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))


def total_work(solved: DataFrame, edges: DataFrame) -> DataFrame:
    """total_work: sum of the out-degrees of reached vertices."""
    return solved.join(out_degrees(edges), solved["v"] == F.col("id"), "left").agg(F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("total_work"))


def hop_histogram(solved: DataFrame) -> DataFrame:
    return solved.groupBy("hops").agg(F.count(F.lit(1)).alias("vertices"))


def timing_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, quartiles (inclusive), their distance, median absolute deviation, least and most of `value`."""
    kept = samples.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min(value).alias("least"), F.max(value).alias("most"))
    off = samples.join(kept, by).withColumn("_off", F.abs(F.col(value) - F.col("q")[1])).groupBy(*by).agg(F.median("_off").alias("mad"))
    return kept.join(off, by).select(*by, F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "mad", "least", "most")


def geometric_mean(frame: DataFrame, value: str) -> DataFrame:
    return frame.agg(F.exp(F.avg(F.log(value))).alias("geometric_mean"))
