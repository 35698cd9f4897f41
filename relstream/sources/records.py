"""JSON records as message queues and log services carry them, and the connectors that speak them.

A record's time is ``__time__`` in epoch ms inside the engine and whole seconds outside (a queue's key, a log's time).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from relstream.schema import fresh
from relstream.streaming.run import for_each_batch


def pack_key(c: Column) -> Column:
    """An int as four bytes, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(c.cast("long")), F.lit(16), F.lit("0")), F.lit(8)))


def unpack_key(c: Column) -> Column:
    """Four bytes, big-endian, as a long with the sign of an int; other lengths give null."""
    n = F.conv(F.hex(c), 16, 10).cast("long")
    return F.when(F.octet_length(c) == 4, F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n))


def decode(df: DataFrame, schema: T.StructType, key: str = "key", value: str = "value") -> DataFrame:
    """Queue messages to columns of ``schema``: fields missing or null are null, ``__time__`` is the key times 1000.

    A binary key is a four-byte integer, as queues carry it; a key of another type is a number or its text.
    """
    k, v = fresh("key"), fresh("value")
    own = T.StructType([f for f in schema.fields if f.name != "__time__"])
    seconds = unpack_key(F.col(key)) if isinstance(df.schema[key].dataType, T.BinaryType) else F.col(key).cast("string").cast("long")
    parsed = df.select(seconds.alias(k), F.from_json(F.col(value).cast("string"), own).alias(v))
    return parsed.select(*[(F.col(k) * 1000).alias("__time__") if f.name == "__time__" else F.col(f"{v}.`{f.name}`") for f in schema.fields])


def encode(df: DataFrame) -> DataFrame:
    """Rows to (key int, value string): nulls are left out, ``__time__`` becomes the key in seconds (now, if there is none)."""
    time = F.coalesce(F.col("__time__"), F.unix_millis(F.current_timestamp())) if "__time__" in df.columns else F.unix_millis(F.current_timestamp())
    body = [F.col(f"`{c}`") for c in df.columns if c != "__time__"]
    return df.select(F.floor(time / 1000).cast("int").alias("key"), F.to_json(F.struct(*body), {"ignoreNullFields": "true"}).alias("value"))


def messages(df: DataFrame) -> DataFrame:
    """Rows as a queue carries them: (key of four bytes, value)."""
    return encode(df).select(pack_key(F.col("key")).alias("key"), "value")


def consume_to(spark: SparkSession, servers: str, topic: str, schema: T.StructType, body: Callable[[DataFrame, int], None], checkpoint: str, from_ms: int | None = None, to_ms: int | None = None) -> StreamingQuery:
    """Pass a topic's rows, batch by batch, to ``body``; with ``to_ms`` rows from that time on are left out, and the query
    ends when all that is there has been read.
    """
    df = kafka_stream(spark, servers, topic, schema, from_ms)
    if to_ms is not None:
        df = df.filter(F.col("__time__") < to_ms)
    return for_each_batch(df, body, checkpoint, available_now=to_ms is not None)


def kafka_options(servers: str, topic: str, from_ms: int | None = None, to_ms: int | None = None, poll: int = 40_000, streaming: bool = True) -> dict[str, str]:
    """Reader options; both bounds are epoch ms. Where no record is at or after ``from_ms`` reading starts at the latest."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.max.poll.records": str(poll), "failOnDataLoss": "false"}
    if from_ms is not None:
        out |= {"startingTimestamp": str(from_ms), "startingOffsetsByTimestampStrategy": "latest"}
    if to_ms is not None and not streaming:
        out["endingTimestamp"] = str(to_ms)
    return out


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType, from_ms: int | None = None) -> DataFrame:
    """A topic as a stream; needs the public Kafka connector package on the class path. New partitions are found by the connector."""
    return decode(spark.readStream.format("kafka").options(**kafka_options(servers, topic, from_ms)).load(), schema)


def kafka_table(spark: SparkSession, servers: str, topic: str, schema: T.StructType, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """A bounded part of a topic; ``to_ms`` is exclusive."""
    return decode(spark.read.format("kafka").options(**kafka_options(servers, topic, from_ms, to_ms, streaming=False)).load(), schema)


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Write rows to a topic: a table at once, a stream as a started query."""
    out = messages(df)
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if df.isStreaming:
        return out.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    return out.write.format("kafka").options(**options).save()


def log_rows(df: DataFrame, topic: str = "", source: str = "") -> DataFrame:
    """Rows as log-service items: (__time__ in seconds, __topic__, __source__, contents map of texts); nulls are left out."""
    body = [c for c in df.columns if not c.startswith("__")]
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in body]), lambda p: p["value"].isNotNull())
    time = F.col("__time__") if "__time__" in df.columns else F.unix_millis(F.current_timestamp())
    return df.select(F.floor(time / 1000).alias("__time__"), F.lit(topic).alias("__topic__"), F.lit(source).alias("__source__"), F.map_from_entries(pairs).alias("contents"))


def from_log_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Log-service items back to columns; texts are cast to the schema's types, reserved columns are kept by name."""
    return df.select(*[
        (F.col("__time__") * 1000).alias("__time__") if f.name == "__time__" else F.col(f.name) if f.name.startswith("__") else F.get(F.array(F.col("contents")[f.name]), 0).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
