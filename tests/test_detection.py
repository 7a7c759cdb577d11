"""Detection AP and AR against the measure spelled out in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from lumenforge.operators import detection as E

DET = "image_id long, class string, det_id long, score double, box struct<x:double,y:double,w:double,h:double>, threshold string"
TRUE = "image_id long, class string, truth_id long, box struct<x:double,y:double,w:double,h:double>, crowd boolean, score int"


def iou(a, b, crowd):
    i = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    u = a[2] * a[3] if crowd else a[2] * a[3] + b[2] * b[3] - i
    return i / u if u > 0 else 0.0


def brute(dets, trues, most):
    """{(class, threshold): (ap, ar)}"""
    positives = defaultdict(int)
    truth = defaultdict(list)
    for image, kind, tid, box, crowd, _ in trues:
        truth[image, kind].append((tid, box, bool(crowd)))
        positives[kind] += not crowd
    groups = defaultdict(list)
    for image, kind, did, score, box, _ in dets:
        groups[image, kind].append((score is None, -(score or 0), did, box))
    out = {}
    for at in E.THRESHOLDS:
        hits = defaultdict(list)
        for (image, kind), rows in groups.items():
            gone = set()
            for none, s, did, box in sorted(rows)[:most]:
                near = [(iou(box, b, c), tid, c) for tid, b, c in truth[image, kind]]
                free = [x for x in near if x[0] >= min(at, 1 - 1e-10) and (x[2] or x[1] not in gone)]
                plain = max([x for x in free if not x[2]], default=None)
                if plain:
                    gone.add(plain[1])
                if plain or not free:
                    hits[kind].append((none, s, image, did, plain is not None))
        for kind, n in positives.items():
            if not n:
                continue
            tp, curve = 0, []
            for k, (*_, hit) in enumerate(sorted(hits[kind]), 1):
                tp += hit
                curve.append((tp / n, tp / k))
            ap = sum(max([p for r, p in curve if r >= step * 0.01], default=0.0) for step in range(101)) / 101
            out[kind, at] = ap, max([r for r, _ in curve], default=0.0)
    return out


def made(seed, images=12):
    r = random.Random(seed)
    box = lambda: (float(r.randint(0, 6)), float(r.randint(0, 6)), float(r.randint(1, 5)), float(r.randint(1, 5)))
    trues = [(i, r.choice("abc"), 100 * i + k, box(), r.choice([True, False, False, None]), 1) for i in range(images) for k in range(r.randint(0, 8))]
    trues += [(99, "only truth", 1, box(), False, 1), (98, "only crowd", 1, box(), True, 1)]
    dets = [(i, r.choice("abc"), 100 * i + k, r.choice([None, 0.5, round(r.random(), 2)]), box(), "clash") for i in range(images) for k in range(r.randint(0, 12))]
    for i, kind, _, b, _, _ in trues[: len(trues) // 2]:
        dets.append((i, kind, len(dets) + 10_000, round(r.random(), 1), (b[0], b[1], b[2], b[3] + r.choice([0, 0, 1])), "clash"))
    return dets, trues


@pytest.mark.parametrize(("seed", "most"), [(1, 100), (2, 100), (3, 3)])
def test_average_precision_and_recall(spark, seed, most):
    dets, trues = made(seed)
    d, t = spark.createDataFrame(dets, DET).repartition(3), spark.createDataFrame(trues, TRUE)
    got = {(r["class"], r.threshold): (r.ap, r.ar) for r in E.precision_recall(E.match_detections(d, t, most=most), t).collect()}
    want = brute(dets, trues, most)
    assert set(got) == set(want)
    for k, (ap, ar) in want.items():
        assert got[k] == pytest.approx((ap, ar), abs=1e-12), k
    total = {r.metric: r.value for r in E.evaluate(d, t, most).collect()}
    assert total["AP"] == pytest.approx(100 * sum(a for a, _ in want.values()) / len(want))
    assert total["AP50"] == pytest.approx(100 * sum(a for (_, x), (a, _) in want.items() if x == 0.5) / len({k for k, _ in want}))


def test_matches_are_a_row_for_each_detection(spark):
    dets, trues = made(5)
    m = E.match_detections(spark.createDataFrame(dets, DET), spark.createDataFrame(trues, TRUE))
    assert m.count() == len(dets) and {len(r.taken) for r in m.collect()} == {len(E.THRESHOLDS)}
    assert E.by_threshold(m).count() == len(dets) * len(E.THRESHOLDS)


def test_no_rows(spark):
    d, t = spark.createDataFrame([], DET), spark.createDataFrame([], TRUE)
    assert {r.metric: r.value for r in E.evaluate(d, t).collect()} == {"AP": None, "AP50": None, "AP75": None, "AR": None}
    _, trues = made(4)
    some = spark.createDataFrame(trues, TRUE)
    assert {r.metric: r.value for r in E.evaluate(d, some).collect()}["AP"] == 0.0
