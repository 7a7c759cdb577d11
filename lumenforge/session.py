"""Session defaults used by tests, the bench and local runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A local session with the engine's defaults; a cluster supplies its own master and sizes."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lumenforge")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, **conf}.items():
        builder = builder.config(k, v)
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
