"""Row numbers over a whole table without one task for all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialise


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """Adds the row's number in the order, from 0.

    Rows are dealt by ranges of the order and numbered within each range; what comes before a range is the sum of
    the counts of the ranges before it, one row for each partition. The dealt rows are a table in the shared folder, so that
    both passes see the same ranges even where an executor is lost in between.
    """
    spark = df.sparkSession
    d = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, rows = 0, []
    for r in sorted(d.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        rows.append((r["_range"], before))
        before += r["n"]
    offsets = spark.createDataFrame(rows, "_range int, _before long")  # as many rows as partitions
    d = d.join(F.broadcast(offsets), "_range")
    number = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return d.withColumn(name, number.cast("long")).drop("_range", "_before")
