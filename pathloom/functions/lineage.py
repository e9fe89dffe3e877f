"""Cutting lineage with reliable checkpoints and written tables in a folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathloom-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there by whatever follows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder's path below the checkpoint folder, for tables that a later step reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints that nothing refers to any more, which it does when the driver collects garbage: for loops that make many."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Stored:
    """A table written as Parquet below the checkpoint folder, until it is dropped: frame reads it, rows counts it.

    With bucket, (a column, a number), rows lie in that many buckets of the column's hash, sorted by it: joins on that column alone find them where they are, and a filter on a
    few of its values reads those values' buckets. With part the table is partitioned by that column. seen names aggregates that are taken while the
    table is written; rows come from there too.
    """

    def __init__(self, df: DataFrame, purpose: str = "stored", bucket: tuple[str, int] | None = None, part: str | None = None, seen: dict[str, Column] | None = None):
        self.spark, self.path = df.sparkSession, shared_folder(df.sparkSession, purpose)
        watch = Observation()
        # Observed where the rows are written: what lies below a shuffle is left out once that is known to be empty.
        dealt = df.repartition(bucket[1], bucket[0]) if bucket else df
        counted = dealt.observe(watch, F.count(F.lit(1)).alias("_rows"), *[c.alias(k) for k, c in (seen or {}).items()])
        self.table = None
        if bucket:
            column, n = bucket
            # Each task holds whole buckets, so a bucket is one file.
            out = counted.write.bucketBy(n, column).sortBy(column)
            self.table = f"{purpose}_{uuid.uuid4().hex}"
            (out.partitionBy(part) if part else out).option("path", self.path).saveAsTable(self.table, format="parquet")
            self.frame = self.spark.table(self.table)
        else:
            (counted.write.partitionBy(part) if part else counted.write).parquet(self.path)
            self.frame = self.spark.read.schema(df.schema).parquet(self.path)
        self.seen = watch.get
        self.about: int = self.seen["_rows"]

    def drop(self) -> None:
        """Delete the files. Frames that still read them fail. Needs a classic session: files are deleted through Hadoop's file systems."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)
