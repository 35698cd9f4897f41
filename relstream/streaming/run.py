"""Running streams: start, wait, stop, metrics, live state."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


#: Seconds after which it is looked again whether any of several queries has failed.
POLL_S = 0.5


def start(df: DataFrame, checkpoint: str, sink: str = "memory", name: str | None = None, mode: str = "append", available_now: bool = False, **options: str) -> StreamingQuery:
    """Start writing a stream; with ``available_now`` it ends when all data there now is done."""
    w = df.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    if name:
        w = w.queryName(name)
    return (w.trigger(availableNow=True) if available_now else w).start()


def for_each_batch(df: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run ``body(batch, id)`` on every micro-batch: joins to refreshed dimensions, sinks without a streaming writer."""
    w = df.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def compute(queries: list[StreamingQuery], seconds: float | None = None) -> None:
    """Wait until all queries have ended, for ``seconds`` in all at most; if any fails, stop all others and raise at once."""
    deadline = None if seconds is None else time.monotonic() + seconds
    while running := [q for q in queries if q.isActive]:
        left = POLL_S if deadline is None else min(POLL_S, deadline - time.monotonic())
        if left <= 0 or any(q.exception() for q in queries):
            break
        try:
            running[0].awaitTermination(left)
        except StreamingQueryException:
            break
    failed = next((q for q in queries if q.exception()), None)
    if failed is not None:
        for q in queries:
            if q.isActive:
                q.stop()
        raise failed.exception()


def rows_of_state(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The live window state of a query, (key, value), as of its last batch."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint)


def with_heartbeat(df: DataFrame, time: str, rate: int = 1) -> DataFrame:
    """The stream united with rows that hold nothing but the present time, so event time goes on while no data comes.

    Filter on any column that data always has to take them out behind the watermark.
    """
    spark = df.sparkSession
    beat = spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("timestamp").alias(time))
    return df.unionByName(beat, allowMissingColumns=True)


class Metrics(StreamingQueryListener):
    """Rows, rates, delays and held state of every batch, newest last; at most ``keep`` of them.

    ``state_rows`` are the rows that operators hold, ``dropped`` those that came behind the watermark, ``waiting`` what
    sources report as not yet read.
    """

    def __init__(self, keep: int = 1000):
        self.keep, self.batches, self.failed = keep, [], []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({
            "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond, "ms": dict(p.durationMs).get("triggerExecution"),
            "watermark": dict(p.eventTime).get("watermark"), "state_rows": sum(o.numRowsTotal for o in p.stateOperators),
            "dropped": sum(o.numRowsDroppedByWatermark for o in p.stateOperators), "waiting": [dict(s.metrics) for s in p.sources],
        })
        del self.batches[: max(0, len(self.batches) - self.keep)]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append(event.exception)
