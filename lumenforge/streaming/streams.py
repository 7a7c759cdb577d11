"""Structured Streaming forms of dedup, mixing and batching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as they come; the schema is given, never guessed."""
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def event_time(df: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Zoneless times as instants, with a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def first_seen(df: DataFrame, keys: Sequence[str], column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The first row of each key that comes while the watermark remembers it; state is dropped behind it (A02 on a stream)."""
    return event_time(df, column, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(df: DataFrame, keys: Sequence[str], column: str = "ts", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, keys, n, total value) per window."""
    d = event_time(df, column, delay).groupBy(F.window(column, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("window.start").alias("start"), *keys, "n", "total")


def mixed_stream(streams: Sequence[DataFrame]) -> DataFrame:
    """Union of streams by shared columns."""
    cols = [c for c in streams[0].columns if all(c in s.columns for s in streams)]
    out = streams[0].select(*cols)
    for s in streams[1:]:
        out = out.unionByName(s.select(*cols))
    return out


def drain(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there into an idempotent sink, then stop."""
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
