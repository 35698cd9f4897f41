"""Session construction."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "relstream", cores: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A local session with the engine's defaults: UTC, ANSI, AQE, RocksDB state. On a cluster, submit with the same settings."""
    n = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | (conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for files that all machines see: ``spark.checkpoint.dir``; a local session may leave it to its warehouse."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
