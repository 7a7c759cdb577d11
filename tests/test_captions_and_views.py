"""METEOR against all alignments, products of blocks against all pairs, strided views and heat maps against numpy, table functions."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.functions import heatmaps as H
from lumenforge.functions import strided as S
from lumenforge.functions import table_functions
from lumenforge.operators import blocks as B
from lumenforge.operators import meteor as O


def every_alignment(h, r, same, fixed):
    """All one-to-one extensions of fixed."""
    open_h = [i for i in range(len(h)) if i not in fixed]

    def go(k, made, used):
        if k == len(open_h):
            yield dict(made)
            return
        yield from go(k + 1, made, used)
        for j in range(len(r)):
            if j not in used and same(h[open_h[k]], r[j]):
                yield from go(k + 1, [*made, (open_h[k], j)], used | {j})

    yield from go(0, list(fixed.items()), set(fixed.values()))


def test_alignments_have_most_matches_and_fewest_chunks():
    rng = random.Random(8)
    equal, alike = (lambda a, b: a == b), (lambda a, b: a.rstrip("s") == b.rstrip("s"))
    for _ in range(400):
        h, r = ([rng.choice("a a as b bs c".split()) for _ in range(rng.randint(0, 6))] for _ in range(2))
        first = O.align(h, r, equal, {})
        best = min((-len(m), O.chunks(m)) for m in every_alignment(h, r, equal, {}))
        assert (-len(first), O.chunks(first)) == best, (h, r)
        second = O.align(h, r, alike, first)
        assert first.items() <= second.items()
        assert (-len(second), O.chunks(second)) == min((-len(m), O.chunks(m)) for m in every_alignment(h, r, alike, first)), (h, r)


def test_scores_and_stages(spark):
    rows = [(1, "the cat sat on the mat", ["on the mat sat the cat", "a dog"]), (2, "cats run", ["cat runs"]), (3, "a big house", ["a large house"]), (4, "", ["x"]), (5, None, ["x"]), (6, "x", []), (7, "x", None), (8, "x", [None, "x"]), (None, "x", ["x"])]
    d = spark.createDataFrame(rows, "meteor_id int, h string, rs array<string>").withColumnRenamed("meteor_id", "key")
    got = {r["key"]: r.meteor for r in O.meteor(d, "key", "h", "rs").collect()}
    assert got[1] == pytest.approx(1 - 0.5 * (3 / 6) ** 3) and got[2] == pytest.approx(0.6 * (1 - 0.5 * (1 / 2) ** 3))
    assert got[4] == got[5] == got[6] == got[7] == 0.0 and got[8] == got[None] == 0.5
    both = {r["key"]: r.meteor for r in O.meteor(d, "key", "h", "rs", stages=("exact", "stem", "synonym"), synonyms=lambda: lambda a, b: {a, b} == {"big", "large"}).collect()}
    assert got[3] == pytest.approx(2 / 3 * (1 - 0.5)) and both[3] == pytest.approx(2.8 / 3 * (1 - 0.5 / 27))
    assert [O.s_stem(w) for w in ("ponies", "horses", "cats", "glass", "bus", "is", "shoes")] == ["pony", "horse", "cat", "glass", "bus", "is", "shoe"]
    with pytest.raises(ValueError):
        O.meteor(d, "key", "h", "rs", stages=("spelling",))


def test_long_captions_end(spark):
    h = " ".join(random.Random(1).choice(["a", "b", "the"]) for _ in range(60))
    d = spark.createDataFrame([(1, h, [h[::-1], h])], "k int, h string, rs array<string>")
    assert O.meteor(d, "k", "h", "rs").first().meteor > 0.95


@pytest.mark.parametrize("nbytes", [900])
def test_blocks_equal_all_pairs(spark, monkeypatch, nbytes):
    monkeypatch.setattr(B.pack, "__defaults__", (nbytes,))
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (60, 5)).astype(float)
    labels = [None if i % 11 == 0 else i % 4 if i % 13 else 99 + i for i in range(60)]
    rows = [(i, x.tolist(), y, "c") for i, (x, y) in enumerate(zip(v, labels, strict=True))] + [(100, None, 1, "c"), (101, [None, 1.0], 1, "c"), (102, [1.0], 1, "c"), (None, [1.0] * 5, 1, "c")]
    e = spark.createDataFrame(rows, "vec_id long, u array<double>, label int, q string").repartition(3)
    asks = e.where("vec_id % 5 = 0")
    got = sorted((r.q, r["rank"], r.i, r.s) for r in B.split_top_k(asks, e, 4).collect() if r.q < 100)
    want = []
    for q in range(0, 60, 5):
        best = sorted((-float(v[q] @ v[i]), i) for i in range(60) if i != q)[:4]
        want += [(q, k + 1, i, -s + 0.0) for k, (s, i) in enumerate(best)]
    assert got == want
    for others in (True, False):
        ranks = {r.q: r["rank"] for r in B.gold_ranks(asks, e, others=others).collect() if r.q < 100}
        for q in range(0, 60, 5):
            order = sorted(((-float(v[q] @ v[i]), -i) for i in range(60) if not others or i != q))
            gold = [k for k, (_, i) in enumerate(order) if labels[q] is not None and labels[-i] == labels[q]]
            assert ranks[q] == (gold[0] if gold else None), q
    assert B.split_top_k(e.where("false"), e, 3).collect() == [] == B.split_top_k(asks, e.where("false"), 3).collect()
    plan = B.split_top_k(asks, e, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_hold_a_bounded_number_of_products():
    n = B.BYTES // (8 * 64)  # rows of a full block of 64 dimensions
    runs = list(B._runs((np.arange(n), np.arange(n) + 1), n))
    assert max(len(k) * n for k, _ in runs) <= B.CELLS < n * n
    assert np.concatenate([k for k, _ in runs]).tolist() == list(range(n)) and all((l == k + 1).all() for k, l in runs)
    assert len(list(B._runs((np.arange(3),), 10 * B.CELLS))) == 3


def test_two_stages_equal_a_window_over_all_pairs(spark):
    from lumenforge.operators import metrics as M

    rng = np.random.default_rng(6)
    rows = [(i, x.tolist(), None if i % 9 == 0 else i % 3) for i, x in enumerate(rng.integers(-2, 3, (40, 3)).astype(float))]
    rows += [(50, None, 1), (51, [float("nan"), 1.0, 1.0], 1), (52, [1.0, None, 0.0], 2), (55, [float("nan")] * 3, 0), (60, None, None)]
    for data in (rows, rows[:7] + rows[40:]):
        e = spark.createDataFrame(data, "vec_id long, u array<double>, label int")
        asks = e.where("vec_id % 5 = 0")
        pairs = asks.selectExpr("vec_id AS q", "u AS qu", "label AS ql").join(e.selectExpr("vec_id AS i", "u", "label AS il"), F.expr("q <> i"))
        pairs = pairs.withColumn("s", F.round(F.aggregate(F.zip_with("qu", "u", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 9))
        want = M.two_stage(pairs, "q", "s", "i", 4, (F.col("ql") == F.col("il")).cast("int")).select("q", "i", "final")
        got = B.two_stage(asks, e, 4)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "BroadcastNestedLoopJoin" in plan  # no pair is sorted or shuffled


def test_strided_views(spark):
    a = np.arange(2 * 3 * 4 * 5, dtype=float).reshape(2, 3, 4, 5)
    d = spark.createDataFrame([(a.ravel().tolist(), 2), (a.ravel().tolist(), 9), ([], 1)], "v array<double>, n int")
    base = S.view("v", [2, 3, 4, 5])
    seen = S.permute(S.flip(S.crop(base, [0, 1, 0, 2], [2, 2, F.col("n"), 3]), 3, 4), (1, 2, 3, 0))
    out = d.select(S.unpack(seen, 4).alias("u"), S.element(seen, 1, 1, 0, 1).alias("e"), S.element(seen, 5, 0, 0, 0).alias("none"), seen["shape"].alias("s")).collect()
    for r, n in zip(out[:2], (2, 4), strict=True):
        want = a[:, 1:3, :n, 2:5][..., ::-1].transpose(1, 2, 3, 0)
        assert r.u == want.ravel().tolist() and r.s == list(want.shape) and r.e == want[1, 1, 0, 1] and r.none is None
    one = d.limit(1).select(S.normalise(S.permute(base, (3, 0, 1, 2)), 1, 4, [0.1, 0.2], [2.0, 4.0]).alias("x")).first().x
    want = (a.transpose(3, 0, 1, 2) / 255 - np.array([0.1, 0.2])[None, :, None, None]) / np.array([2.0, 4.0])[None, :, None, None]
    assert np.allclose(one, want.ravel())
    assert d.select(S.unpack(S.crop(base, [0, 0, 0, 5], [1, 1, 1, 1]), 4).alias("x")).first().x == []


def test_heat_maps(spark):
    rng = np.random.default_rng(4)
    g = rng.random((3, 4))
    d = spark.createDataFrame([(g.ravel().tolist(), [(0.2, 0.4, 0.6)] * 30), ([2.0] * 12, [(0.0, 0.0, 0.0)] * 30)], "g array<double>, image array<struct<r:double,g:double,b:double>>")
    r = d.select(H.stretch("g").alias("s"), H.resize("g", 3, 4, 3, 4).alias("same"), H.resize("g", 3, 4, 6, 5).alias("big"), H.blur("g", 3, 4, 0.7).alias("blur"), H.attention_overlay("g", 3, 4, "image", 6, 5).alias("o")).collect()
    assert np.allclose(r[0].s, ((g - g.min()) / (g.max() - g.min())).ravel()) and r[1].s == [0.0] * 12
    assert np.allclose(r[0].same, g.ravel()) and np.allclose(r[1].big, 2.0) and np.allclose(r[1].blur, 2.0)
    k = H.kernel(0.7)
    near = lambda i, n: [[abs(d), H._mirror(i + d, n)] for d in range(-len(k) + 1, len(k))]
    want = [[sum(k[a] * k[b] * g[y2, x2] for (a, y2), (b, x2) in itertools.product(near(y, 3), near(x, 4))) for x in range(4)] for y in range(3)]
    assert np.allclose(r[0].blur, np.ravel(want))
    assert [tuple(round(x, 9) for x in p) for p in r[1].o] == [(0.0, 0.0, 0.0)] * 30  # a flat map shows the image alone
    assert all(0 <= x <= 1 for p in r[0].o for x in p)
    c = spark.range(1).select(*[F.struct(H.colours(F.lit(x))).alias(n) for n, x in (("low", 0.0), ("mid", 0.5), ("high", 1.0))]).first()
    assert tuple(c.low[0]) == (0.0, 0.0, 0.5) and tuple(c.mid[0]) == (0.5, 1.0, 0.5) and tuple(c.high[0]) == (0.5, 0.0, 0.0)


def test_table_functions(spark):
    table_functions.register(spark)
    d = spark.createDataFrame([(1, 1, "b", "y"), (1, 0, "a", "x"), (2, 0, "a", None)], "conv_id long, turn long, role string, text string")
    got = spark.sql("SELECT * FROM prefix_turns(TABLE({d}) PARTITION BY conv_id ORDER BY turn)", d=d).collect()
    assert sorted((r.conv_id, r.turn, r.history) for r in got) == [(1, 0, []), (1, 1, ["a: x"]), (2, 0, [])]
    none = spark.createDataFrame([(None,), ("file:/nowhere/x.tar",)], "path string")
    assert [(r.path, r.member, r.error is None) for r in spark.sql("SELECT * FROM load_members(TABLE({d}) PARTITION BY path)", d=none).collect()] == [("file:/nowhere/x.tar", None, False)]
