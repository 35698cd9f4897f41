"""Bounded replays: a table as a stream of micro-batches, run to its end, and the result as a table.

Batches and results are files in the folder that all machines share, so a replay survives lost executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from relstream.schema import fresh
from relstream.session import shared_folder
from relstream.streaming import run

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replay:
    """One run: ``stream`` gives micro-batches, ``table`` runs what was built on them and gives its rows."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.streams = spark, f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}", 0

    def stream(self, df: DataFrame, batches: int, batch: str | None = None, order: str | None = None, ends: list[Row] | None = None) -> DataFrame:
        """``df`` as micro-batches: those of column ``batch`` (0 to batches - 1, taken off), or ranges of ``order``.

        Each row of ``ends`` is a batch of its own behind them: late times that let event time pass all rows. A batch is
        one file.
        """
        if batch is None:
            bounds = df.approxQuantile(order, [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
            batch = fresh("batch")
            df = df.withColumn(batch, sum((F.col(order) > b).cast("int") for b in bounds) if bounds else F.lit(0))
        self.streams += 1
        source = f"{self.folder}/in-{self.streams}"
        own = df.drop(batch)
        for i in range(batches):
            df.where(F.col(batch) == i).drop(batch).coalesce(1).write.mode("append").parquet(source)
        for r in ends or []:
            self.spark.createDataFrame([[r.asDict().get(c) for c in own.columns]], own.schema).coalesce(1).write.mode("append").parquet(source)
        return self.spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def table(self, done: DataFrame) -> DataFrame:
        """All rows that the stream gives in append mode."""
        out = f"{self.folder}/out"
        self._with_state(lambda: run.start(done, f"{self.folder}/checkpoint", "parquet", available_now=True, path=out))
        return self.spark.read.schema(done.schema).parquet(out)

    def each_batch(self, done: DataFrame, body: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
        """What ``body`` makes of every batch that the stream gives; a batch that is run again replaces its rows."""
        out = f"{self.folder}/out"
        write = lambda b, i: body(b).write.mode("overwrite").parquet(f"{out}/batch={i}")
        self._with_state(lambda: run.for_each_batch(done, write, f"{self.folder}/checkpoint", available_now=True))
        return self.spark.read.schema(f"{schema}, batch long").parquet(out).drop("batch")

    def state(self, done: DataFrame) -> DataFrame:
        """The window state that the stream has built up when all its rows are in, (key, value)."""
        self._with_state(lambda: run.start(done, f"{self.folder}/checkpoint", "noop", mode="complete", available_now=True))
        return run.rows_of_state(self.spark, f"{self.folder}/checkpoint")

    def _with_state(self, start) -> None:
        name = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, ROCKS)
        try:
            run.compute([start()])
        finally:
            self.spark.conf.set(name, before)
