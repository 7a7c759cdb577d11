"""Average precision and recall of detections: greedy matching by score, interpolated precision over 101 recalls.

Boxes are (x, y, width, height). A detection meets only the true boxes of its image and class. Of one image and class the `most` best
detections count (a limit of the measure). In score order each takes the free true box of largest overlap, at or above the threshold;
boxes to be ignored (crowds) are taken only where no other can be, may be taken often, and their detections don't count. Ties: scores
by detection id, overlaps by the larger true id.

Matching goes over the images of an Arrow batch together, a rank of detections at a time, at all thresholds at once; it gives a row for each detection, not for
each threshold. Ranks run over a whole class: rows are dealt by ranges of score, counted within
each range and shifted by the counts of the ranges before, so no class has to fit one task. Interpolated precision at a
recall is the largest precision at that recall or more, so it is a maximum for each of 101 steps, added up before the shuffle, and a
running maximum over the steps from above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialise

#: Thresholds of the measure and steps of recall (fixed values).
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
STEPS = 101
#: Pairs of boxes that a task compares at a time.
PAIRS = 1 << 19


def match_detections(detections: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, most: int = 100) -> DataFrame:
    """(image_id, class, det_id, score, taken, hits, ignored): the true box that each detection takes at each threshold, null for none, and, a bit a threshold, whether it counts as right or not at all.

    detections: image_id, class, det_id, score, box; truths: image_id, class, truth_id, box, crowd. Null scores come last, null crowds are none; rows without
    an image or class match nothing, and detections among them count as wrong. Detections may repeat, each counts; ids of true boxes tell
    those of an image and class apart.
    """
    if len(thresholds) > 62:
        raise ValueError("62 thresholds at most")
    order = [F.col("score").desc_nulls_last(), "det_id", "box"]
    d = detections.select("image_id", "class", "det_id", "score", "box").withColumn("_r", F.row_number().over(W.partitionBy("image_id", "class").orderBy(*order))).where(F.col("_r") <= most)
    sides = [F.col(f"box.{c}").cast("double").alias(c) for c in "xywh"]
    d = d.groupBy("image_id", "class").agg(F.array_sort(F.collect_list(F.struct("_r", F.col("det_id").cast("bigint").alias("id"), F.col("score").cast("double").alias("score"), *sides))).alias("dets"))
    t = truths.where("image_id is not null and class is not null and truth_id is not null").groupBy("image_id", "class")
    t = t.agg(F.collect_list(F.struct(F.col("truth_id").cast("bigint").alias("id"), F.coalesce("crowd", F.lit(False)).alias("crowd"), *sides)).alias("trues"))
    groups = d.join(t, ["image_id", "class"], "left").select("image_id", "class", "dets", "trues")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dets", "trues"))
            end = np.cumsum(n * m)
            at = 0
            while at < b.num_rows:  # images of at most PAIRS pairs, or one
                before = end[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(end, before + PAIRS, "right")))
                part = b.slice(at, to - at)
                dets, trues = part.column("dets").flatten(), part.column("trues").flatten()
                taken, crowd = _greedy(n[at:to], _boxes(dets), m[at:to], _boxes(trues), pc.struct_field(trues, "id").to_numpy(zero_copy_only=False), pc.struct_field(trues, "crowd").to_numpy(zero_copy_only=False), np.array(thresholds))
                ids = pc.struct_field(trues, "id").take(pa.array(taken.ravel(), mask=taken.ravel() < 0))
                size = pa.array(np.arange(len(taken) + 1, dtype=np.int32) * len(thresholds))
                bits = 1 << np.arange(len(thresholds), dtype=np.int64)
                rows = pa.array(np.repeat(np.arange(to - at), n[at:to]))
                cells = [part.column("image_id").take(rows), part.column("class").take(rows), pc.struct_field(dets, "id"), pc.struct_field(dets, "score"), pa.ListArray.from_arrays(size, ids), pa.array(((taken >= 0) & ~crowd) @ bits), pa.array(crowd @ bits)]
                yield pa.RecordBatch.from_arrays(cells, names=["image_id", "class", "det_id", "score", "taken", "hits", "ignored"])
                at = to

    keys = ", ".join(f"{c} {groups.schema[c].dataType.simpleString()}" for c in ("image_id", "class"))
    return groups.mapInArrow(run, f"{keys}, det_id bigint, score double, taken array<bigint>, hits bigint, ignored bigint")


def _boxes(a: pa.StructArray) -> np.ndarray:
    return np.stack([pc.struct_field(a, c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "xywh"])


def _greedy(n: np.ndarray, d: np.ndarray, m: np.ndarray, t: np.ndarray, ids: np.ndarray, crowd: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(taken, ignored), a row a detection, a column a threshold: the place of the true box, -1 for none, and whether that is a crowd. n and m: detections, in order, and true boxes of each image."""
    image = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(image)) - (np.cumsum(n) - n)[image]
    width = m[image]
    a = np.repeat(np.arange(len(image)), width)
    b = (np.cumsum(m) - m)[image][a] + np.arange(len(a)) - (np.cumsum(width) - width)[a]
    crowd = crowd.astype(bool)
    side = lambda p: np.maximum(0.0, np.minimum(d[p][a] + d[p + 2][a], t[p][b] + t[p + 2][b]) - np.maximum(d[p][a], t[p][b]))
    both, area = side(0) * side(1), d[2][a] * d[3][a]
    union = np.where(crowd[b], area, area + t[2][b] * t[3][b] - both)
    iou = np.divide(both, union, out=np.zeros(len(a)), where=union > 0)
    near = iou >= thresholds.min()
    a, b, iou = a[near], b[near], iou[near]
    by = np.lexsort((-ids[b], -iou, crowd[b], a, rank[a]))  # a rank's pairs lie together, those of a detection in order of choice
    a, b, iou = a[by], b[by], iou[by]
    owner = np.repeat(np.arange(len(m)), m)
    by = np.lexsort((ids, owner))
    box = np.empty(len(ids), np.int64)  # equal ids of an image are one box
    box[by] = np.cumsum(np.r_[True, (np.diff(ids[by]) != 0) | (np.diff(owner[by]) != 0)])[: len(by)] - 1
    gone = np.zeros((len(ids), len(thresholds)), bool)
    taken, ignored = np.full((len(image), len(thresholds)), -1), np.zeros((len(image), len(thresholds)), bool)
    cuts = np.flatnonzero(np.r_[True, np.diff(rank[a]) != 0]) if len(a) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(a)], strict=True):
        x, y = a[lo:hi], b[lo:hi]
        free = (iou[lo:hi, None] >= np.minimum(thresholds, 1 - 1e-10)) & (crowd[y][:, None] | ~gone[box[y]])
        starts = np.flatnonzero(np.r_[True, np.diff(x) != 0])
        first = np.minimum.reduceat(np.where(free, np.arange(hi - lo)[:, None], hi - lo), starts, axis=0)
        row, col = np.nonzero(first < hi - lo)
        won = y[first[row, col]]
        taken[x[starts[row]], col], ignored[x[starts[row]], col] = won, crowd[won]
        plain = ~crowd[won]
        gone[box[won[plain]], col[plain]] = True
    return taken, ignored


def by_threshold(matches: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(class, threshold, hit, ignored), a row for each detection and threshold."""
    each = [F.struct(F.lit(float(x)).alias("threshold"), _bit("hits", i).alias("hit"), _bit("ignored", i).alias("ignored")) for i, x in enumerate(thresholds)]
    return matches.select("class", F.explode(F.array(*each)).alias("m")).select("class", "m.*")


def _bit(mask: str, i: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << i).cast("bigint")) != 0


def precision_recall(matches: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(class, threshold, ap, ar, positives) of each class that has true boxes: interpolated precision and largest recall."""
    positives = truths.where(~F.coalesce("crowd", F.lit(False))).groupBy("class").agg(F.count("*").alias("positives"))
    rows = materialise(matches.select("class", "score", "image_id", "det_id", "hits", "ignored"), "matches")  # ranges are sampled first: without a table the matching would run twice
    order = [F.col("score").desc_nulls_last(), F.col("image_id"), F.col("det_id"), F.col("hits"), F.col("ignored")]
    d = materialise(rows.repartitionByRange("class", *order[:3]).withColumn("_range", F.spark_partition_id()), "ranks")
    each = range(len(thresholds))
    counts = {f"tp{i}": _bit("hits", i) for i in each} | {f"n{i}": ~_bit("ignored", i) for i in each}
    ends = d.groupBy("class", "_range").agg(*[F.count_if(c).alias(f"_{name}") for name, c in counts.items()])
    before = W.partitionBy("class").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # as many rows as ranges
    ends = ends.select("class", "_range", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in counts])
    inside = W.partitionBy("_range", "class").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.select("class", "_range", "hits", *[F.sum(c.cast("long")).over(inside).alias(name) for name, c in counts.items()]).where("hits <> 0")
    d = d.join(F.broadcast(ends), ["class", "_range"]).join(F.broadcast(positives), "class")  # a row a class and range, a row a class
    # between two hits precision falls, so the largest at any recall is that of a hit
    each = [F.when(_bit("hits", i), F.struct(F.lit(float(x)).alias("threshold"), (F.col(f"tp{i}") + F.col(f"_tp{i}")).alias("tp"), (F.col(f"n{i}") + F.col(f"_n{i}")).alias("n"))) for i, x in enumerate(thresholds)]
    d = d.select("class", "positives", F.explode(F.array(*each)).alias("m")).where("m is not null")
    d = d.select("class", "m.threshold", (F.col("m.tp") / F.col("positives")).alias("recall"), (F.col("m.tp") / F.col("m.n")).alias("precision"))
    k = F.floor(F.col("recall") * 100)
    k = F.when((k + 1) * F.lit(0.01) <= F.col("recall"), k + 1).when(k * F.lit(0.01) > F.col("recall"), k - 1).otherwise(k)
    best = d.withColumn("k", F.least(k, F.lit(STEPS - 1)).cast("int")).groupBy("class", "threshold", "k").agg(F.max("precision").alias("p"), F.max("recall").alias("r"))
    every = positives.select("class", "positives", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("k"))
    above = W.partitionBy("class", "threshold").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    curve = every.join(best, ["class", "threshold", "k"], "left").withColumn("p", F.coalesce(F.max("p").over(above), F.lit(0.0)))
    return curve.groupBy("class", "threshold").agg((F.sum("p") / STEPS).alias("ap"), F.coalesce(F.max("r"), F.lit(0.0)).alias("ar"), F.first("positives").alias("positives"))


def summary(by_class: DataFrame) -> DataFrame:
    """(metric, value): AP, AP50, AP75, AR, means over classes (and thresholds), and AP-<class> for each class, times 100."""
    mean = lambda c: F.avg(c) * 100
    at = lambda x: F.when(F.col("threshold") == x, F.col("ap"))
    total = by_class.agg(mean("ap").alias("AP"), mean(at(0.5)).alias("AP50"), mean(at(0.75)).alias("AP75"), mean("ar").alias("AR"))
    total = total.unpivot([], ["AP", "AP50", "AP75", "AR"], "metric", "value")
    return total.unionByName(by_class.groupBy(F.concat(F.lit("AP-"), F.col("class").cast("string")).alias("metric")).agg(mean("ap").alias("value")))


def evaluate(detections: DataFrame, truths: DataFrame, most: int = 100) -> DataFrame:
    """Matching, curves and summary in one."""
    return summary(precision_recall(match_detections(detections, truths, most=most), truths))
