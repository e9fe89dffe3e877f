"""Results of runs as JSON lines and CSV, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_runs(runs: DataFrame, path: str) -> None:
    """path.json and path.csv (with a header; nulls are a backslash and N, so empty strings stay). Executors write the parts. Existing ones are refused."""
    runs.write.json(f"{path}.json", ignoreNullFields=False)
    runs.write.csv(f"{path}.csv", header=True, nullValue="\\N", emptyValue="", escape='"', quoteAll=False)


def read_runs(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The runs of path.json and those of path.csv."""
    return spark.read.schema(schema).json(f"{path}.json"), spark.read.schema(schema).csv(f"{path}.csv", header=True, nullValue="\\N", emptyValue="", escape='"')
