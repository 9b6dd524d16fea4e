"""Reading the library's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder of parquet tables, one file or directory each."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
