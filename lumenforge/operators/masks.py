"""Mask fusion, panoptic and instance inference, matching costs."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V


def order_by_score(df: DataFrame, view: str, score: str, mask: str) -> DataFrame:
    """Masks in score order; at an overlap limit of 1 nothing is suppressed."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(view).orderBy(F.desc(score), mask)))


def average_similarity(df: DataFrame, view: str, mask: str, vector: str) -> DataFrame:
    """(view, mask, avg_sim): mean cosine with all masks of the view, itself counted as 0.

    The sum of cosines with unit vectors is the inner product with their sum, so the view's sum is all that is joined: no pair of masks is formed.
    """
    u = df.select(view, mask, V.normalise(vector).alias("_u"))
    sums = u.select(view, F.posexplode("_u").alias("_p", "_x")).groupBy(view, "_p").agg(F.sum("_x").alias("_x")).groupBy(view).agg(F.array_sort(F.collect_list(F.struct("_p", "_x"))).alias("_s"))
    n = u.groupBy(view).agg(F.count("*").alias("_n"))
    d = u.join(sums, view).join(n, view)
    return d.select(view, mask, ((V.dot("_u", F.transform("_s", lambda s: s["_x"])) - V.dot("_u", "_u")) / F.col("_n")).alias("avg_sim"))


def similarity_matrix(df: DataFrame, view: str, mask: str, vector: str) -> DataFrame:
    """(view, a, b, sim): all pairs of a view's masks, the diagonal 0 (J10). The pairs are the result; a view has some dozens of masks."""
    u = df.select(view, F.col(mask).alias("a"), V.normalise(vector).alias("_u"))
    v = u.withColumnsRenamed({"a": "b", "_u": "_v"})
    return u.join(v, view).select(view, "a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(V.dot("_u", "_v")).alias("sim"))


def similarity_totals(df: DataFrame, view: str, mask: str, vector: str) -> DataFrame:
    """(view, n, total): how many pairs similarity_matrix() has for each view, and their sum, without forming a pair.

    All cosines of a view add up to the squared length of the sum of its unit vectors; those of a mask with itself, which count as 0, to the squared
    length of the mask's own sum. Pairs of unequal lengths, or with a null entry, have no cosine: they count and add nothing, as in a sum over pairs.
    """
    rows = df.where(F.col(view).isNotNull()).select(view, F.col(mask).alias("_m"), V.normalise(vector).alias("_u"))
    whole = rows.where(F.col("_u").isNotNull() & F.forall("_u", lambda x: x.isNotNull()))
    parts = whole.select(view, "_m", F.size("_u").alias("_d"), F.posexplode("_u").alias("_p", "_x"))

    def squares(d: DataFrame, name: str, *keys: str) -> DataFrame:
        sums = d.groupBy(view, *keys, "_d", "_p").agg(F.sum("_x").alias("_x"))
        return sums.groupBy(view).agg(F.sum(F.col("_x") * F.col("_x")).alias(name))

    d = rows.groupBy(view).agg((F.count("*") * F.count("*")).alias("n"))
    d = d.join(squares(parts, "_all"), view, "left").join(squares(parts.where("_m is not null"), "_own", "_m"), view, "left")
    return d.select(view, "n", F.coalesce(F.col("_all") - F.coalesce("_own", F.lit(0.0)), F.lit(0.0)).alias("total"))


def group_softmax(df: DataFrame, group: str, score: Column, name: str = "weight") -> DataFrame:
    """Softmax of a score over its group."""
    w = W.partitionBy(group)
    d = df.withColumn("_s", score).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return d.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_s", "_e")


def fuse_masks(df: DataFrame, view: str, mask: str, score: str, vector: str, whole: Column) -> DataFrame:
    """(view, mask, score, weight, fused): each mask's feature blended with the whole view's by the softmax of its score less its average similarity (M8: J10, A21, A20, V05)."""
    d = df.join(average_similarity(df, view, mask, vector), [view, mask])
    d = group_softmax(d, view, F.col(score) - F.col("avg_sim"))
    return d.withColumn("fused", V.blend(F.col("weight"), whole, vector))


def fold_pixels(df: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    """(keys, feature): acc = normalise(acc + v) over a pixel's masks in score order."""
    d = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), V.doubles(vector).alias("v")))).alias("_v"))
    zero = F.transform(F.get("_v", 0)["v"], lambda x: F.lit(0.0))
    return d.select(*keys, F.aggregate("_v", zero, lambda acc, s: V.normalise(V.add(acc, s["v"]))).alias("feature"))


def panoptic_pixels(probs: DataFrame, pixel: list[str], query: str, score: str, label: str, mask: str, no_object: int, least: float) -> DataFrame:
    """(pixel, query): the query of the largest score times mask probability among those that are kept."""
    kept = probs.where((F.col(label) != no_object) & (F.col(score) > least))
    return kept.groupBy(*pixel).agg(F.max_by(query, F.struct(F.col(score) * F.col(mask), -F.col(query))).alias(query))


def panoptic_segments(probs: DataFrame, view: str, pixel: list[str], query: str, score: str, label: str, mask: str, things: Column, no_object: int, least: float, overlap: float) -> DataFrame:
    """(view, query, label, isthing, segment): queries whose won pixels are the least share of their mask; things are numbered by query, stuff of one label shares the first's number."""
    won = panoptic_pixels(probs, [view, *pixel], query, score, label, mask, no_object, least)
    area = probs.where(F.col(mask) >= 0.5).groupBy(view, query).agg(F.count("*").alias("whole"))
    both = probs.where(F.col(mask) >= 0.5).join(won, [view, *pixel, query]).groupBy(view, query).agg(F.count("*").alias("won"))
    kept = area.join(both, [view, query]).where(F.col("won") >= overlap * F.col("whole"))
    d = kept.join(probs.select(view, query, label).distinct(), [view, query]).withColumn("isthing", things)
    same = W.partitionBy(view, F.when(F.col("isthing"), F.concat(F.lit("t"), F.col(query))).otherwise(F.concat(F.lit("s"), F.col(label))))
    d = d.withColumn("_first", F.min(query).over(same))
    return d.withColumn("segment", F.dense_rank().over(W.partitionBy(view).orderBy("_first"))).select(view, query, label, "isthing", "segment", "won")


def instance_scores(df: DataFrame, keys: list[str], score: str, mask: str) -> DataFrame:
    """(keys, score): class score times the mean mask probability inside the mask."""
    inside = F.col(mask) > 0.5
    return df.groupBy(*keys).agg((F.first(score) * F.sum(F.when(inside, F.col(mask)).otherwise(0.0)) / (F.sum(inside.cast("double")) + 1e-6)).alias("score"))


def semantic_scores(classes: DataFrame, masks: DataFrame, query: str, label: str, pixel: list[str], class_prob: str, mask_prob: str) -> DataFrame:
    """(pixel, label, score): sum over queries of class times mask probability."""
    return classes.join(masks, query).groupBy(*pixel, label).agg(F.sum(F.col(class_prob) * F.col(mask_prob)).alias("score"))


def average_views(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over augmented predictions."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def pair_costs(df: DataFrame, keys: list[str], logit: str, target: str) -> DataFrame:
    """(keys, dice, ce): dice and sigmoid cross-entropy of a predicted and a target mask over their points."""
    p = 1 / (1 + F.exp(-F.col(logit)))
    t = F.col(target)
    ce = F.greatest(F.col(logit), F.lit(0.0)) - F.col(logit) * t + F.log1p(F.exp(-F.abs(logit)))
    return df.groupBy(*keys).agg((1 - (2 * F.sum(p * t) + 1) / (F.sum(p) + F.sum(t) + 1)).alias("dice"), F.avg(ce).alias("ce"))


def hungarian(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest assignment of the smaller side (shortest augmenting paths, n² m); -1 for rows left over."""
    c = np.asarray(cost, dtype=np.float64)
    turned = c.shape[0] > c.shape[1]
    c = c.T if turned else c
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        least, back, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, col = i, -1
        while True:
            slack = c[row] - u[row] - v
            better = ~used & (slack < least)
            least[better], back[better] = slack[better], col
            j = int(np.where(used, np.inf, least).argmin())
            d = least[j]
            u[i] += d
            k = np.flatnonzero(used)
            u[owner[k]] += d
            v[k] -= d
            least[~used] -= d
            used[j] = True
            col = j
            if owner[j] < 0:
                break
            row = owner[j]
        while col >= 0:
            prev = back[col]
            owner[col] = owner[prev] if prev >= 0 else i
            col = prev
    out = np.full(n, -1)
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    if not turned:
        return out
    back_out = np.full(m, -1)
    back_out[out] = np.arange(n)
    return back_out


def match_on_line(preds: DataFrame, targets: DataFrame, image: str, pred: str, target: str, x: str, y: str) -> DataFrame:
    """(image, pred, target, x, y): cheapest assignment of as many predictions as targets whose cost is a convex function of y - x, such as its square.

    On a line such an assignment is the one in order: swapping two crossed pairs never costs more. So no table of costs is formed; where an image has more of one side, the last of that side stay over,
    which is not always cheapest, and `match` is the way. Rows without image or place are left out.
    """

    def ranked(d: DataFrame, key: str, at: str) -> DataFrame:
        d = d.where(F.col(image).isNotNull() & F.col(at).isNotNull())
        return d.select(image, key, at, F.row_number().over(W.partitionBy(image).orderBy(at, key)).alias("_k"))

    return ranked(preds, pred, x).join(ranked(targets, target, y), [image, "_k"]).drop("_k")


def match(df: DataFrame, image: str, pred: str, target: str, cost: str, most: int = 4_000_000) -> DataFrame:
    """(image, pred, target): cheapest assignment of an image's predictions to its targets (J14). A task holds one image's costs; an image of more than `most` of them ends the job."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"{image} {key[0]} has {len(pdf)} costs, more than {most}")
        (preds, i), (targets, j) = (np.unique(pdf[c].to_numpy(), return_inverse=True) for c in (pred, target))
        table = np.full((len(preds), len(targets)), np.inf)
        table[i, j] = pdf[cost].to_numpy()
        found = hungarian(np.where(np.isinf(table), 1e18, table))
        hit = np.flatnonzero(found >= 0)
        hit = hit[np.isfinite(table[hit, found[hit]])]  # pairs without a cost don't match
        return pd.DataFrame({image: key[0], pred: preds[hit], target: targets[found[hit]]})

    types = {c: df.schema[c].dataType.simpleString() for c in (image, pred, target)}
    return df.groupBy(image).applyInPandas(one, ", ".join(f"{k} {v}" for k, v in types.items()))
