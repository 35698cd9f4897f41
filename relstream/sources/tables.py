"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; timestamps without zone are read as UTC instants, which event-time functions need."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    plain = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def latest_partition(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The rows of the greatest partition value of a partitioned folder; other partitions are not read."""
    df = spark.read.parquet(path)
    newest = df.agg(F.max(column)).collect()[0][0]
    return df.filter(F.col(column).eqNullSafe(F.lit(newest)))
