"""First-wins and last-wins rows, dense ids, and agreement of key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import number_rows


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the order (A02); the order has to be total, as row order means nothing here."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order."""
    return first_wins(df, keys, [F.desc(c) for c in order])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """first_wins() for a few columns by a combined aggregate: nothing is sorted, and each task sends one row for a key."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(v, rank).alias(v) for v in values])


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """last_wins() likewise."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(v, rank).alias(v) for v in values])


def dense_ids(df: DataFrame, key: str, order: str, name: str = "dense_id") -> DataFrame:
    """(key, dense id from 0 by first appearance) (A04). The numbering sorts keys, not rows, and by ranges."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    return number_rows(first, ["_first", key], name).drop("_first")


def label_or_default(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """label by key, the number of labels where the key has none."""
    n = labels.agg(F.count("*").alias("_n"))
    return df.join(labels.select(key, label), key, "left").crossJoin(F.broadcast(n)).withColumn(label, F.coalesce(F.col(label), F.col("_n"))).drop("_n")


def remap_categories(df: DataFrame, things: DataFrame, stuff: DataFrame, key: str) -> DataFrame:
    """contiguous id by way of two maps (key, id), things first, and whether it is a thing."""
    t = things.select(key, F.col("id").alias("_t"))
    s = stuff.select(key, F.col("id").alias("_s"))
    return df.join(t, key, "left").join(s, key, "left").withColumn("category_id", F.coalesce("_t", "_s")).withColumn("isthing", F.col("_t").isNotNull()).drop("_t", "_s")


def reverse_or_fail(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """value by key; a key that the table lacks ends the job."""
    out = df.join(table.select(key, F.col(value).alias("_v"), F.lit(True).alias("_hit")), key, "left")
    bad = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string")))
    return out.withColumn(value, F.when(F.col("_hit"), F.col("_v")).otherwise(bad.cast(table.schema[value].dataType))).drop("_v", "_hit")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one of the two has; no rows if the sets are equal."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def require_same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    """Fail with some examples unless both have the same keys."""
    odd = [tuple(r) for r in key_difference(a, b, key).limit(5).collect()]
    if odd:
        raise ValueError(f"keys differ, for example {odd}")


def shared_columns(*frames: DataFrame) -> list[str]:
    """Columns that all frames have, in the first one's order."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]


def union_shared(*frames: DataFrame) -> DataFrame:
    """Union of the frames' shared columns."""
    cols = shared_columns(*frames)
    out = frames[0].select(*cols)
    for f in frames[1:]:
        out = out.unionByName(f.select(*cols))
    return out


def union_splits(datasets: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Per split the union of all datasets' tables, streams apart; other splits than train may come from one dataset only."""
    out: dict[str, DataFrame] = {}
    for split in sorted({s for d in datasets.values() for s in d}):
        parts = [d[split] for d in datasets.values() if split in d]
        if split != "train" and len(parts) > 1:
            raise ValueError(f"split {split} comes from {len(parts)} datasets")
        for stream in (False, True):
            same = [p for p in parts if p.isStreaming == stream]
            if same:
                out[f"{split}_stream" if stream else split] = union_shared(*same)
    return out


def check_ratios(names: Sequence[str], ratios: dict[str, float]) -> None:
    """Every dataset has a ratio and every ratio its dataset."""
    missing, more = sorted(set(names) - set(ratios)), sorted(set(ratios) - set(names))
    if missing or more:
        raise ValueError(f"ratios missing for {missing}, unexpected for {more}")


def ratio_problems(df: DataFrame, column: str, ratios: dict[str, float]) -> DataFrame:
    """(name, problem): values of the column that have no ratio, and ratios whose value doesn't come (U06); null values are no source."""
    there = df.select(F.col(column).alias("name")).where("name is not null").distinct()
    named = df.sparkSession.createDataFrame([(x,) for x in ratios], "name string")
    missing, more = there.join(named, "name", "left_anti"), named.join(there, "name", "left_anti")
    return missing.withColumn("problem", F.lit("missing")).unionByName(more.withColumn("problem", F.lit("unexpected")))


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work items whose output isn't there yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")
