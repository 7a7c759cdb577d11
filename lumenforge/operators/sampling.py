"""Seeded sampling, limits and mixtures: reruns and any partitioning give the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(seed: int, *cols: str | Column) -> Column:
    """A digest that is fixed by the seed and the columns: what seeded orders sort by."""
    c = [F.col(x) if isinstance(x, str) else x for x in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(x.cast("string"), F.lit("")) for x in c]))


def uniform(seed: int, *cols: str | Column) -> Column:
    """A number in (0, 1) that is fixed by the seed and the columns: the digest's first 52 bits."""
    return (F.conv(F.substring(seeded(seed, *cols), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def limit_rows(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows of each group in the order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def sample_rows(df: DataFrame, group: Sequence[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group without replacement, all of smaller ones."""
    return limit_rows(df, group, [seeded(seed, key), key], n)


def sample_or_pad(df: DataFrame, group: str, key: str, values: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """(group, place, values): exactly n rows of each group, the sampled ones in key order, then null-padded ones."""
    kept = sample_rows(df.select(group, key, *values), [group], key, n, seed)
    kept = kept.withColumn("place", (F.row_number().over(W.partitionBy(group).orderBy(key)) - 1).cast("int"))
    have = kept.groupBy(group).agg(F.max("place").alias("_top"))
    pad = have.where(F.col("_top") < n - 1).select(group, F.explode(F.sequence(F.col("_top") + 1, F.lit(n - 1))).alias("place"))
    for v in values:
        pad = pad.withColumn(v, F.lit(None).cast(df.schema[v].dataType))
    return kept.select(group, "place", *values).unionByName(pad)


def weighted_sample(df: DataFrame, group: Sequence[str], weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group without replacement by weight: the smallest of -ln(u) / w (T13). Rows without weight never come."""
    live = df.where(F.col(weight) > 0)
    return limit_rows(live, group, [-F.ln(uniform(seed, key)) / F.col(weight), key], n)


def uncertain_points(df: DataFrame, group: Sequence[str], logit: str, key: str, n: int, share: float = 0.75, seed: int = 0) -> DataFrame:
    """share * n points of each group nearest to logit 0 and the rest of n by hash."""
    most = int(share * n)
    near = F.row_number().over(W.partitionBy(*group).orderBy(F.abs(logit), key))
    df = df.withColumn("_near", near)
    rest = F.row_number().over(W.partitionBy(*group, F.col("_near") <= most).orderBy(seeded(seed, key), key))
    return df.withColumn("_rest", rest).where((F.col("_near") <= most) | (F.col("_rest") <= n - most)).drop("_near", "_rest")


def oversampled_points(df: DataFrame, group: Sequence[str], logit: str, key: str, n: int, oversample: float = 3.0, share: float = 0.75, seed: int = 0) -> DataFrame:
    """n points of each group: share * n, the nearest to logit 0 among oversample * n seeded ones, and the rest of n seeded from those not drawn so far.

    Groups with fewer points give what they have.
    """
    drawn, most = int(oversample * n), int(share * n)
    order = [seeded(seed, key), key]
    d = df.withColumn("_place", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    sure = F.row_number().over(W.partitionBy(*group, F.col("_place") <= drawn).orderBy(F.abs(logit), key))
    near = (F.col("_place") <= drawn) & (F.col("_sure") <= most)
    fill = (F.col("_place") > drawn) & (F.col("_place") <= drawn + n - most)
    return d.withColumn("_sure", sure).where(near | fill).drop("_place", "_sure")


def seeded_choice(seed: int, key: str | Column, choices: Sequence[str]) -> Column:
    """One of the choices, fixed by the seed and the row's key (T12: a prompt for each row)."""
    at = F.least(F.lit(len(choices) - 1), F.floor(uniform(seed, key) * len(choices))).cast("int")
    return F.get(F.array(*[F.lit(c) for c in choices]), at)


def mixture(sources: dict[str, DataFrame], ratios: dict[str, float], rows: int, key: str, seed: int = 0) -> DataFrame:
    """About ratio * rows rows of each source, fewer where it has fewer, in one table with `source` (T14). Each source's share is cut by its own hash order, whose places are numbered by ranges."""
    from .dedup import check_ratios
    from .ordering import number_rows

    check_ratios(list(sources), ratios)
    whole, out = sum(ratios.values()), None
    for name, df in sources.items():
        part = number_rows(df.withColumn("_h", seeded(seed, key)), ["_h", key], "_k").where(F.col("_k") < round(rows * ratios[name] / whole))
        part = part.drop("_h", "_k").withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def mixture_stream(sources: Sequence[tuple[str, DataFrame, float]], key: str, seed: int = 0) -> DataFrame:
    """Rows of all sources with an interleaving `turn`: source i's k-th row comes at k / ratio, as a mixing loader would deal them. Sources are numbered by ranges."""
    from .ordering import number_rows

    out = None
    for name, df, ratio in sources:
        part = number_rows(df.select(key).withColumn("_h", seeded(seed, key)), ["_h", key], "_k")
        part = part.select(key, F.lit(name).alias("source"), ((F.col("_k") + 1) / F.lit(float(ratio))).alias("turn"))
        out = part if out is None else out.unionByName(part)
    return out


def mask_tokens(tokens: Column, key: Column, mask_id: int, vocabulary: int, share: float = 0.15, seed: int = 0) -> Column:
    """array<struct<input, label>>: a share of the tokens is chosen; of them 80 % become mask_id, 10 % another token, 10 % stay; label is -100 elsewhere."""

    def one(t: Column, i: Column) -> Column:
        u, v = uniform(seed, key, i), uniform(seed + 1, key, i)
        other = F.floor(uniform(seed + 2, key, i) * vocabulary).cast("int")
        chosen = u < share
        return F.struct(F.when(chosen & (v < 0.8), mask_id).when(chosen & (v < 0.9), other).otherwise(t).alias("input"), F.when(chosen, t).otherwise(-100).alias("label"))

    return F.transform(tokens, one)


def frame_indices(n: int, length: Column, how: str = "uniform", seed: int = 0, key: Column | None = None) -> Column:
    """Indices of n frames of a video (S11): evenly from the start, or half of them from either half by hash, ascending."""
    if how == "uniform":
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * length / F.lit(float(n))).cast("int"))
    half = F.floor(length / 2).cast("int")

    def pick(lo: Column, hi: Column) -> Column:
        ordered = F.array_sort(F.transform(F.sequence(lo, hi - 1), lambda i: F.struct(seeded(seed, key if key is not None else F.lit(0), i).alias("h"), i.alias("i"))))
        return F.transform(F.slice(ordered, 1, n // 2), lambda s: s["i"])

    return F.array_sort(F.concat(pick(F.lit(0), half), pick(half, length.cast("int"))))
