"""A stream that a program fills by inserting rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from relstream.schema import InconsistentColumns


class InsertableStream:
    """Rows inserted here come out of ``read()``; every ``flush`` is a micro-batch.

    Rows pass through JSON files in a folder that all executors see, so they survive restarts.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, folder: str):
        self.spark, self.schema, self.folder = spark, schema, folder
        self._held: list[tuple] = []

    def insert(self, *values) -> InsertableStream:
        if len(values) != len(self.schema.fields):
            raise InconsistentColumns(f"{len(values)} values for {len(self.schema.fields)} columns")
        self._held.append(values)
        return self

    def flush(self) -> None:
        rows, self._held = self._held, []
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(self.folder)

    def read(self, batch_per_flush: bool = True) -> DataFrame:
        r = self.spark.readStream.schema(self.schema)
        return (r.option("maxFilesPerTrigger", 1) if batch_per_flush else r).json(self.folder)
