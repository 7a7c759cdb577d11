"""Scores, dedup, windows, sampling, vectors, maps and masks on hand cases and by properties."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.functions import geometry as G
from lumenforge.functions import images as I
from lumenforge.functions import vectors as V
from lumenforge.operators import captions as C
from lumenforge.operators import dedup as D
from lumenforge.operators import dialogue as T
from lumenforge.operators import maps as P
from lumenforge.operators import masks as K
from lumenforge.operators import metrics as M
from lumenforge.operators import sampling as S
from lumenforge.operators import scorers
from lumenforge.operators import windows as N


def value(spark, c):
    return spark.range(1).select(c.alias("o")).first()["o"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_answer_weights(spark):
    d = spark.createDataFrame([(1, ["a", "a", "b", "c"])], "k int, answers array<string>")
    assert {r["answer"]: r["weight"] for r in M.answer_weights(d, "k", "answers").collect()} == {"a": 0.5, "b": 0.25, "c": 0.25}


def test_first_and_last_wins_whatever_the_partitions(spark):
    rows = [(1, 0, "x"), (2, 1, "y"), (1, 2, "z")]
    for n in (1, 3):
        d = spark.createDataFrame(rows, "k int, pos int, v string").repartition(n)
        for first, last in ((D.first_by(d, ["k"], ["pos"], ["v"]), D.last_by(d, ["k"], ["pos"], ["v"])), (D.first_wins(d, ["k"], ["pos"]), D.last_wins(d, ["k"], ["pos"]))):
            assert {r["k"]: r["v"] for r in first.collect()} == {1: "x", 2: "y"}
            assert {r["k"]: r["v"] for r in last.collect()} == {1: "z", 2: "y"}


def test_consensus(spark):
    golds = [(i, "cat" if i < 3 else "dog") for i in range(10)]
    d = spark.createDataFrame([("The cat.", golds)], "p string, a array<struct<answer_id:int,answer:string>>")
    assert d.select(M.consensus(F.col("p"), F.col("a"))).first()[0] == pytest.approx(0.9)
    same = spark.createDataFrame([("cat", [(1, "cat"), (1, "cat")])], "p string, a array<struct<answer_id:int,answer:string>>")
    assert same.select(M.consensus(F.col("p"), F.col("a"))).first()[0] == 0.0  # equal records exclude each other


def test_ranks_and_recalls(spark):
    d = spark.createDataFrame([(1, 1, 0.9, True), (1, 2, 0.5, False), (2, 1, 0.9, False), (2, 2, 0.5, True)], "q int, i int, s double, g boolean")
    r = M.rank_golds(d, "q", "i", "s", F.col("g"))
    assert {x["q"]: x["rank"] for x in r.collect()} == {1: 0, 2: 1}
    assert M.recalls(r).first().asDict() == {"r1": 50.0, "r5": 100.0, "r10": 100.0, "r_mean": pytest.approx(250 / 3)}


def test_by_group_has_all_and_each(spark):
    d = spark.createDataFrame([("x", "u", 1), ("x", "v", 0), ("y", "v", 1)], "a string, b string, hit int")
    got = {(r["grp"], r["value"]): (r["n"], r["s"]) for r in M.by_group(d, ["a", "b"], s=F.avg("hit")).collect()}
    assert got == {("All", "All"): (3, pytest.approx(2 / 3)), ("a", "x"): (2, 0.5), ("a", "y"): (1, 1.0), ("b", "u"): (1, 1.0), ("b", "v"): (2, 0.5)}


def test_keys_and_labels(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(map(tuple, D.key_difference(a, b, "k").collect())) == [(1, "left"), (3, "right")]
    with pytest.raises(ValueError):
        D.require_same_keys(a, b, "k")
    D.require_same_keys(a, a, "k")
    table = spark.createDataFrame([(1, "one")], "k int, v string")
    assert D.reverse_or_fail(a.where("k = 1"), table, "k", "v").first()["v"] == "one"
    with pytest.raises(Exception, match="no v for k"):
        D.reverse_or_fail(a, table, "k", "v").collect()
    with pytest.raises(ValueError):
        D.check_ratios(["a"], {"b": 1})
    with pytest.raises(ValueError):
        D.union_splits({"x": {"val": a}, "y": {"val": b}})


def test_dialogue_prefixes(spark):
    d = spark.createDataFrame([(1, i, f"t{i}") for i in range(3)], "c int, t int, m string")
    assert sorted(len(r["history"]) for r in T.prefixes(d, "c", "t", ["m"]).collect()) == [0, 1, 2]
    r = T.last_as_target(d, "c", "t", ["m"]).first()
    assert [x["m"] for x in r["context"]] == ["t0", "t1"] and r["target"]["m"] == "t2"


def test_chunks_drop_the_short_rest(spark):
    d = spark.createDataFrame([(1, i, str(i)) for i in range(5)], "k int, p int, c string")
    assert sorted(r["captions"] for r in T.chunk_captions(d, "k", "p", "c", 2, 10).collect()) == ["0 1", "2 3"]
    assert T.chunk_captions(d, "k", "p", "c", 2, 5).count() == 3


def test_token_sequence(spark):
    s = value(spark, T.token_sequence(F.array(F.lit(5)), F.array(F.array(F.lit(1)), F.array(F.lit(2))), F.array(F.lit(3)), 0, 10, 11, 12))
    assert s["input_ids"] == [5, 0, 1, 0, 2, 0, 3, 0]
    assert s["token_type_ids"] == [10, 10, 11, 11, 12, 12, 11, 11]
    assert s["labels"] == [-1] * 6 + [3, 0]


def test_moving_median_is_the_lower(spark):
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([4, 1, 3, 2])], "g int, o int, v double")
    assert [r["w_median"] for r in N.moving(d, ["g"], ["o"], "v", 4).orderBy("o").collect()] == [4.0, 1.0, 3.0, 2.0]


def test_sampling_is_seeded_and_whole(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    a = sorted(map(tuple, S.sample_rows(d, ["g"], "id", 50, 1).collect()))
    assert a == sorted(map(tuple, S.sample_rows(d.repartition(7), ["g"], "id", 50, 1).collect())) and len(a) == 150
    assert a != sorted(map(tuple, S.sample_rows(d, ["g"], "id", 50, 2).collect()))
    p = S.sample_or_pad(d.where("g = 0 or id < 5"), "g", "id", ["id"], 20)
    assert {r["g"]: (r["n"], r["m"]) for r in p.groupBy("g").agg(F.count("*").alias("n"), F.count("id").alias("m")).collect()} == {0: (20, 20), 1: (20, 2), 2: (20, 1)}
    assert S.weighted_sample(d.withColumn("w", F.when(F.col("id") < 10, 1.0).otherwise(0.0)), ["g"], "w", "id", 50).count() == 10


def test_vectors(spark):
    assert value(spark, V.norm(V.normalise(arr(3, 4)))) == pytest.approx(1)
    assert value(spark, V.normalise(arr(0, 0))) == [0.0, 0.0]
    assert value(spark, V.nonzero_sum(arr(1, -1))) is False and value(spark, V.any_nonzero(arr(1, -1))) is True
    assert sum(value(spark, V.softmax(arr(1, 2, 3)))) == pytest.approx(1)
    x = [random.Random(0).uniform(-1, 1) for _ in range(10)]
    back = value(spark, V.dequantise(V.quantise(arr(*x), 4), F.lit(10)))
    assert max(abs(a - b) for a, b in zip(x, back, strict=True)) < 2 / 255
    assert value(spark, V.dequantise(V.quantise(arr(2, 2), 4), F.lit(2))) is not None
    assert value(spark, V.pad(F.array(F.lit(1)), 3, F.lit(-1))) == [1, -1, -1]


def test_geometry(spark):
    assert [value(spark, G.voxel(F.lit(p))) for p in (-0.9999, 0.0, 1.0)] == [0, 128, 256]
    assert value(spark, G.heading(F.lit(0.0), F.lit(math.sin(0.5)), F.lit(0.0), F.lit(math.cos(0.5)))) == pytest.approx(1.0)
    assert value(spark, G.heading(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == 0.0
    d = spark.createDataFrame([], "m int, x int, y int")
    assert tuple(d.agg(*[c.alias(k) for k, c in G.mask_box(F.lit(True), "x", "y", 512, 400).items()]).first()) == (0, 0, 512, 400)
    p = value(spark, G.follow_actions(F.array(F.lit("turn_left"), F.lit("move_forward")), F.lit(0), F.lit(0), F.lit(0.0), 1.0, 90.0, 1.0))
    assert (p["x"], p["y"]) == (pytest.approx(0, abs=1e-12), pytest.approx(1))
    r = value(spark, G.robot_to_world(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0)))
    assert (r["x"], r["z"]) == (pytest.approx(0, abs=1e-12), pytest.approx(-2))


def test_voxels_keep_every_point(spark):
    r = random.Random(3)
    d = spark.createDataFrame([(1, r.uniform(-1, 1), r.uniform(-1, 1), r.uniform(-1, 1), [1.0, float(i)]) for i in range(200)], "s int, x double, y double, z double, f array<double>")
    v = P.voxelise(d, "s", "x", "y", "z", "f", 2)
    assert v.agg(F.sum("n")).first()[0] == 200 and all(abs(x["mean"][0] - 1) < 1e-12 for x in v.collect())


def test_occupied_wins_and_last_pixel_wins(spark):
    d = spark.createDataFrame([(1.0, 1.0, 0.1), (1.0, 1.0, 0.6), (2.0, 1.0, 0.1), (-3.0, 1.0, 0.1), (1.0, float("nan"), 0.1)], "x double, y double, z double")
    got = {(r["cell_x"], r["cell_y"]): r["value"] for r in P.occupied_map(d, "x", "y", "z", 10, [0.5], 1.0).collect()}
    assert got == {(1, 1): 2, (2, 1): 1}
    s = spark.createDataFrame([(0, 0, 0, 1, "a"), (0, 0, 1, 0, "b")], "cx int, cy int, row int, col int, l string")
    assert P.semantic_map(s, "cx", "cy", "row", "col", "l").first()["l"] == "b"


def test_average_similarity_counts_itself_as_zero(spark):
    d = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [1.0, 1.0])], "v int, m int, f array<double>")
    c = math.sqrt(0.5)
    assert [r["avg_sim"] for r in K.average_similarity(d, "v", "m", "f").collect()] == [pytest.approx(c / 2)] * 2
    assert sorted(r["sim"] for r in K.similarity_matrix(d, "v", "m", "f").collect()) == [0, 0, pytest.approx(c), pytest.approx(c)]


def test_similarity_totals_equal_the_sum_over_pairs(spark):
    r = np.random.default_rng(3)
    rows = [(i % 3, i, r.normal(size=4).tolist()) for i in range(30)] + [(0, 0, [1.0, 2.0, 0.0, 0.0]), (0, None, [1.0, 1.0, 0.0, 0.0]), (1, 40, [1.0]), (1, 41, [1.0]), (2, 42, None), (2, 43, [None, 1.0, 0.0, 0.0]), (None, 1, [1.0]), (7, 1, [3.0]), (8, 1, None), (9, 1, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "v int, m int, f array<double>")
    want = K.similarity_matrix(d, "v", "m", "f").groupBy("v").agg(F.count("*").alias("n"), F.sum("sim").alias("total")).collect()
    got = K.similarity_totals(d, "v", "m", "f")
    assert {x.v: (x.n, pytest.approx(x.total, abs=1e-9)) for x in want} == {x.v: (x.n, x.total) for x in got.collect()}
    same = spark.range(40_000).selectExpr("1 AS v", "id AS m", "array(1.0D, 0.0D) AS f")  # 1.6 billion pairs
    assert tuple(K.similarity_totals(same, "v", "m", "f").first()) == (1, 1_600_000_000, 40_000.0**2 - 40_000)


def test_assignment_on_a_line_is_cheapest(spark):
    r = np.random.default_rng(4)
    p = [(i // 7, i, float(r.integers(0, 9))) for i in range(35)]
    t = [(i // 7, i, float(r.integers(0, 9))) for i in range(35)]
    preds, targets = spark.createDataFrame(p, "i int, p int, x double"), spark.createDataFrame(t, "i int, t int, y double")
    costs = preds.join(targets, "i").withColumn("c", (F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))
    want = K.match(costs.select("i", "p", "t", "c"), "i", "p", "t", "c").join(costs, ["i", "p", "t"]).agg(F.sum("c")).first()[0]
    found = K.match_on_line(preds, targets, "i", "p", "t", "x", "y")
    assert found.agg(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).first()[0] == want
    assert found.count() == found.select("p").distinct().count() == found.select("t").distinct().count() == 35
    many = spark.range(2500).selectExpr("1 AS i", "id AS p", "cast(-id AS double) AS x", "id AS t", "cast(id AS double) AS y")  # more costs than `match` takes
    assert K.match_on_line(many.select("i", "p", "x"), many.select("i", "t", "y"), "i", "p", "t", "x", "y").where("p + t = 2499").count() == 2500


def test_assignment_is_cheapest(spark):
    r = np.random.default_rng(0)
    for _ in range(100):
        n, m = map(int, r.integers(1, 6, 2))
        c = r.integers(0, 9, (n, m)).astype(float)
        a = K.hungarian(c)
        got = sum(c[i, j] for i, j in enumerate(a) if j >= 0)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert got == best and (a >= 0).sum() == min(n, m)
    d = spark.createDataFrame([(1, 1, 1, 5.0), (1, 1, 2, 1.0), (1, 2, 1, 1.0), (1, 2, 2, 5.0)], "i int, p int, t int, c double")
    assert sorted((x["p"], x["t"]) for x in K.match(d, "i", "p", "t", "c").collect()) == [(1, 2), (2, 1)]


def test_caption_metrics(spark):
    d = spark.createDataFrame([(1, "the cat sat on the mat", ["the cat sat on the mat", "a cat"]), (2, "dogs run", ["dogs run fast today"])], "k int, h string, rs array<string>")
    b = C.bleu(d, "k", "h", "rs").first()
    assert b["bleu1"] == pytest.approx(math.exp(1 - 10 / 8))  # all unigrams hit; two words short
    rouge = {r["k"]: r["v"] for r in d.select("k", C.rouge_l("h", "rs").alias("v")).collect()}
    assert rouge[1] == pytest.approx(1.0) and 0 < rouge[2] < 1
    ci = {r["k"]: r["cider"] for r in C.cider(d, "k", "h", "rs").collect()}
    assert ci[1] > ci[2] > 0
    assert value(spark, C.lcs_length(F.array(*map(F.lit, "abcbdab")), F.array(*map(F.lit, "bdcaba")))) == 4


def test_scorer_retries_and_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        seen = {"n": 0}

        def f(b):
            seen["n"] += 1
            calls.add(1)
            if seen["n"] == 1:
                raise RuntimeError("once")
            return b.assign(s=b["id"] * 2)

        return f

    d = scorers.score(spark.range(5).coalesce(1), make, "id long, s long", batch_rows=2, attempts=2, wait=0.0)
    assert sorted(r["s"] for r in d.collect()) == [0, 2, 4, 6, 8]


def test_images():
    a = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (I.invert(I.invert(a)) == a).all() and (I.flip(I.flip(a)) == a).all() and I.centre_crop(a, 2, 2).shape == (2, 2, 3)
    assert I.polygon_mask(np.array([[0, 0], [4, 0], [4, 4], [0, 4]]), 4, 4).all()
    for f in (I.identity, I.auto_contrast, I.equalise, I.invert, I.solarize):
        assert f(a).shape == a.shape


def test_row_numbers_follow_the_order(spark):
    from lumenforge.operators.ordering import number_rows

    d = spark.range(500).select(((F.col("id") * 7919) % 101).alias("a"), "id").repartition(6)
    got = [(r["a"], r["id"], r["place"]) for r in number_rows(d, ["a", "id"]).collect()]
    assert [x[2] for x in sorted(got)] == list(range(500))
    assert number_rows(d.where("false"), ["a"]).count() == 0


def test_boxes_and_cameras_of_either_form(spark):
    d = spark.createDataFrame([("[1,2,3,4,5,6]",), ("[[1,2,3],[4,5,6]]",), ("[1]",)], "b string")
    assert [r[0] for r in d.select(G.box_corners(F.col("b"))).collect()] == [[[1, 2, 3], [4, 5, 6]]] * 2 + [None]
    cam = '{"intrinsic": [[1.0]], "extrinsic": [[2.0]]}'
    d = spark.createDataFrame([('{"view_params": {"v": %s}}' % cam,), ('{"v": %s}' % cam,)], "d string")
    assert [r[0]["intrinsic"] for r in d.select(G.view_camera(F.col("d"), F.lit("v"))).collect()] == [[[1.0]]] * 2


def test_attention_heads(spark):
    a = F.array(arr(1, 2), arr(3, 4))
    assert value(spark, V.weighted_attention(a, F.array(arr(1, -1), arr(1, 1)))) == [2.0, 2.0]
    assert value(spark, V.late_interaction(a, arr(1, 0))) == 3.0


def test_image_operations_keep_their_rules():
    r = np.random.default_rng(3)
    a = r.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    for name, f in I.OPERATIONS.items():
        for m in (0.0, 0.3, 1.0):
            for s in (1, -1):
                out = f(a, m, s)
                assert out.shape == a.shape and out.dtype == np.uint8, name
    assert len(I.OPERATIONS) == 14
    assert (I.warp(a, [[1, 0, 0], [0, 1, 0]]) == a).all() and (I.rotate(a, 0) == a).all() and (I.shear(a) == a).all()
    assert (I.warp(a, [[1, 0, 2], [0, 1, 0]])[:, 2:] == a[:, :-2]).all() and (I.warp(a, [[1, 0, 2], [0, 1, 0]])[:, :2] == 128).all()
    assert (I.colour(a, 1.0).astype(int) - a <= 0).all() and (abs(I.colour(a, 1.0).astype(int) - a) <= 1).all()
    grey = I.colour(a, 0.0)
    assert (grey[..., 0] == grey[..., 1]).all()
    flat = np.full((5, 5, 3), 90, dtype=np.uint8)
    assert (I.contrast(flat, 1.9) == 90).all() and (I.sharpness(flat, 1.9) == 90).all() and (I.rotate(flat, 33, fill=90) == 90).all()
    square = np.zeros((6, 6, 1), dtype=np.uint8)
    square[1, 2] = 200
    assert I.rotate(square, 90)[4, 1, 0] == 200 or I.rotate(square, 90).max() > 0
    cut = I.cutout(a, 4, 3, 4, fill=1)
    assert (cut[2:6, 1:5] == 1).all() and (cut[0] == a[0]).all()
    classes, masks = I.class_masks(np.array([[1, 2], [255, 1]]))
    assert classes == [1, 2] and masks.sum(axis=(1, 2)).tolist() == [2, 1]
    assert I.pad_to(a, 4).shape == (12, 8, 3)
    images, mask = I.batch([a, a[:4, :5]])
    assert images.shape == (2, 9, 7, 3) and mask.sum() == 63 - 20


def test_random_augmentation_is_seeded(spark):
    from lumenforge.operators import augment as A

    r = np.random.default_rng(5)
    rows = [(i, 6, 5, 3, r.integers(0, 256, 90, dtype=np.uint8).tobytes()) for i in range(40)] + [(99, 6, 5, 3, None)]
    d = spark.createDataFrame(rows, "k long, height int, width int, channels int, pixels binary")
    one, two, other = ({x["k"]: bytes(x["pixels"]) for x in A.augment(d.repartition(n), "k", 2, seed=s).collect()} for n, s in ((1, 0), (3, 0), (1, 7)))
    assert one == two and one != other and len(one) == 40
    drawn = [A.random_operations(k, 2, tuple(I.OPERATIONS)) for k in range(4000)]
    names = [n for x in drawn for n, _ in x]
    assert 0.45 < len(names) / 8000 < 0.55 and len(set(names)) == 14


def test_assignment_of_sparse_costs(spark):
    rows = [(1, 10, 1, 5.0), (1, 10, 2, 1.0), (1, 11, 2, 2.0), (2, 1, 1, 3.0), (3, 1, 1, 2.0), (3, 2, 1, 1.0)]
    d = spark.createDataFrame(rows, "image long, pred long, target long, cost double")
    assert {tuple(x) for x in K.match(d, "image", "pred", "target", "cost").collect()} == {(1, 10, 1), (1, 11, 2), (2, 1, 1), (3, 2, 1)}
    with pytest.raises(Exception, match="more than 2"):
        K.match(d, "image", "pred", "target", "cost", most=2).collect()


def test_word_tokens_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    from lumenforge.operators import word_tokens

    path = str(P.path("word_bpe_49k.json"))
    with open(path, encoding="utf-8") as f:
        mine = word_tokens.WordTokens(f.read())
    other = tokenizers.Tokenizer.from_file(path)
    texts = ["A photo of a cat, sitting!", "it's 2024 & they've 3.5 cats", "", "éèß naïve 字 🙂", "x" * 300, "a  b\tc\nd", "<|endoftext|> end"]
    for t in texts:
        assert mine.encode(t) == other.encode(t, add_special_tokens=False).ids, t
    assert mine.decode(mine.encode("a photo of a cat")) == "a photo of a cat "
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(50, None)], "k int, t string")
    rows = {r["k"]: r["ids"] for r in word_tokens.fixed(d, "k", "t", path).collect()}
    assert all(len(x) == 77 and x[0] == 49406 for x in rows.values()) and rows[4][-1] == 49407 and rows[50][:3] == [49406, 49407, 0]
