"""Moving statistics, ring buffers and schedules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import number_rows


def moving(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, size: int = 20) -> DataFrame:
    """Adds median (the lower one), avg, max and latest of the last `size` values."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(-(size - 1), 0)
    seen = F.sort_array(F.collect_list(value).over(w))
    d = df.withColumn("_s", seen).withColumn("w_avg", F.avg(value).over(w)).withColumn("w_max", F.max(value).over(w)).withColumn("w_value", F.last(value).over(w))
    return d.withColumn("w_median", F.get("_s", F.floor((F.size("_s") - 1) / 2).cast("int"))).drop("_s")


def ring_buffer(df: DataFrame, seq: str, size: int) -> DataFrame:
    """The latest `size` rows by sequence number."""
    top = df.agg(F.max(seq).alias("_top"))
    return df.crossJoin(F.broadcast(top)).where(F.col(seq) > F.col("_top") - size).drop("_top")  # one row


def ordered_values(df: DataFrame, group: str, order: str, value: str, name: str = "values") -> DataFrame:
    """(group, values in order), for the folds."""
    d = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_v"))
    return d.select(group, F.transform("_v", lambda x: x["v"]).alias(name))


def warmup_lr(step: Column, most_steps: int, start: float, top: float) -> Column:
    """Linear from start, at most top."""
    return F.least(F.lit(top), start + (top - start) * step / F.lit(float(max(most_steps, 1))))


def cosine_lr(epoch: Column, epochs: int, start: float, least: float) -> Column:
    return (start - least) * 0.5 * (1 + F.cos(math.pi * epoch / epochs)) + least


def step_lr(epoch: Column, start: float, least: float, decay: float) -> Column:
    return F.greatest(F.lit(least), start * F.pow(F.lit(decay), epoch))


def ramp(epoch: Column, iteration: Column, per_epoch: int) -> Column:
    """min(1, (epoch n + iteration) / n)."""
    return F.least(F.lit(1.0), (epoch * per_epoch + iteration) / F.lit(float(per_epoch)))


def batches(df: DataFrame, order: Sequence[str], size: int, drop_last: bool = False) -> DataFrame:
    """Adds batch, the rows' number in the whole table's order over size."""
    d = number_rows(df, order, "_r").withColumn("batch", F.floor(F.col("_r") / size))
    if drop_last:
        d = d.withColumn("_n", F.count("*").over(W.partitionBy("batch"))).where(F.col("_n") == size).drop("_n")
    return d.drop("_r")


def collate(df: DataFrame, batch: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row for a batch with each column's values in order."""
    d = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns))).alias("_s"))
    return d.select(batch, *[_field("_s", c).alias(c) for c in columns])


def _field(structs: str, name: str) -> Column:
    return F.transform(structs, lambda x: x[name])


def epochs(df: DataFrame, n: int) -> DataFrame:
    """The table n times with its epoch."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def shard(df: DataFrame, pos: str, total: int, jobs: int) -> DataFrame:
    """Adds job: contiguous ranges of total // jobs + 1 places."""
    return df.withColumn("job", F.floor(F.col(pos) / (total // jobs + 1)).cast("int"))


def rank_shard(df: DataFrame, pos: str, total: int, world: int) -> DataFrame:
    """(.., rank) by turns; the first rows come again until every rank has as many."""
    pad = -total % world
    d = df.withColumn("_at", F.array(F.col(pos).cast("long")))
    d = d.withColumn("_at", F.when(F.col(pos) < pad, F.concat("_at", F.array((F.col(pos) + total).cast("long")))).otherwise(F.col("_at")))
    return d.withColumn("_at", F.explode("_at")).withColumn("rank", F.pmod("_at", F.lit(world)).cast("int")).drop("_at")
