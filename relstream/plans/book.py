"""The book of registered queries: callables by name, and the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relstream.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000
EVENTS = "(SELECT *, epoch_us(ts) // 1000 AS ms, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its name, with DuckDB SQL of its rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their time in epoch ms and their value in cents."""
    return load(spark, sf, "events").withColumn("ms", F.unix_millis("ts")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
