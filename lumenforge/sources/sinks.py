"""Result files, leaderboards, logs and idempotent appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import first_wins, unfinished


def save_result(df: DataFrame, path: str, key: str | None = None, order: Sequence[str] = ("rank", "pos"), fmt: str = "json") -> None:
    """All ranks' results in one folder, the first of each key if one is given."""
    (first_wins(df, [key], list(order)) if key else df).write.mode("overwrite").format(fmt).save(path)


def leaderboard_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row, a map of answers by id (K03). The format wants one document; it is for result sets, not corpora."""
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))).alias("answers"))


def leaderboard_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """(questionId, prediction) as strings."""
    return df.select(F.col(key).cast("string").alias("questionId"), F.col(value).cast("string").alias("prediction"))


def append_metrics(df: DataFrame, path: str) -> None:
    """Metrics as JSON lines, added to those that are there."""
    df.write.mode("append").json(path)


def save(df: DataFrame, path: str, append: bool = False) -> None:
    """A table by the path's extension, as a folder of that format."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in ("json", "csv", "parquet", "orc"):
        raise ValueError(f"no writer for .{ext}")
    w = df.write.mode("append" if append else "overwrite")
    (w.option("header", True) if ext == "csv" else w).format(ext).save(path)


def save_points(df: DataFrame, path: str, scene: str = "scene_id") -> None:
    """Point clouds or voxels by scene (K07): a scene's rows are together, large scenes in several files."""
    df.repartition(F.col(scene), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(scene).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Add the rows whose key isn't in the table at path yet; the rows added."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    new = unfinished(df, spark.read.parquet(path), key) if there else df
    new.write.mode("append").parquet(path)
    return new
