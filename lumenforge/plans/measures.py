"""More registered queries: caption metrics, both directions of retrieval, the map chain, images, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vectors as V
from ..operators import augment as A
from ..operators import blocks as B
from ..operators import captions as C
from ..operators import maps as P
from ..operators import metrics as M
from .catalog import _DOUBLES, _POINTS, Tables, _points, _uniform_sql, query, r6

_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


# --- captions -----------------------------------------------------------------------------------------------------

_GRAMS = (
    f"WITH t AS (SELECT item_id, {_TOKENS.format('replace(text, chr(116) || chr(104), chr(122))')} AS h, {_TOKENS.format('text')} AS r0, {_TOKENS.format('reverse(text)')} AS r1 FROM benchmark), "
    "s AS (SELECT item_id, -1 AS k, h AS w FROM t UNION ALL SELECT item_id, 0, r0 FROM t UNION ALL SELECT item_id, 1, r1 FROM t), n AS (SELECT unnest([1, 2, 3, 4]) AS n), "
    "p AS (SELECT item_id, k, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM s, n WHERE len(w) >= n), g AS (SELECT item_id, k, n, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS c FROM p GROUP BY ALL), "
)


def _captions(t: Tables) -> DataFrame:
    """A changed copy of each passage against the passage and its mirror image."""
    return t.benchmark.select("item_id", F.replace("text", F.lit("th"), F.lit("z")).alias("h"), F.array("text", F.reverse("text")).alias("rs"))


@query(
    "bleu_captions",
    _GRAMS + "z AS (SELECT sum(len(h)) AS hl, sum(CASE WHEN abs(len(r1) - len(h)) < abs(len(r0) - len(h)) OR (abs(len(r1) - len(h)) = abs(len(r0) - len(h)) AND len(r1) < len(r0)) THEN len(r1) ELSE len(r0) END) AS rl FROM t), "
    "m AS (SELECT item_id, n, g, max(c) AS m FROM g WHERE k >= 0 GROUP BY ALL), hit AS (SELECT g.n, sum(least(c, m)) AS hit FROM g JOIN m USING (item_id, n, g) WHERE k = -1 GROUP BY 1), al AS (SELECT n, sum(c) AS al FROM g WHERE k = -1 GROUP BY 1), "
    "q AS (SELECT n, ln(hit / al) AS l FROM hit JOIN al USING (n)), c AS (SELECT n, exp(sum(l) OVER (ORDER BY n) / n) * CASE WHEN hl >= rl THEN 1.0 ELSE exp(1 - rl / hl) END AS b FROM q, z) "
    "SELECT round(max(b) FILTER (n = 1), 6) AS bleu1, round(max(b) FILTER (n = 2), 6) AS bleu2, round(max(b) FILTER (n = 3), 6) AS bleu3, round(max(b) FILTER (n = 4), 6) AS bleu4 FROM c",
)
def bleu(t: Tables) -> DataFrame:
    """BLEU-1 to BLEU-4 over the corpus."""
    return C.bleu(_captions(t), "item_id", "h", "rs").select(*[r6(F.col(f"bleu{n}")).alias(f"bleu{n}") for n in range(1, 5)])


@query(
    "cider_captions",
    _GRAMS + "dc AS (SELECT count(*) AS docs FROM t), df AS (SELECT n, g, count(DISTINCT item_id) AS d FROM g WHERE k >= 0 GROUP BY ALL), w AS (SELECT item_id, k, g.n, g.g, c * (ln(docs) - ln(greatest(1.0, coalesce(d, 0)))) AS w FROM g CROSS JOIN dc LEFT JOIN df ON df.n = g.n AND df.g = g.g), "
    "nn AS (SELECT item_id, k, n, sqrt(sum(w * w)) AS nn FROM w GROUP BY ALL), dot AS (SELECT r.item_id, r.k, r.n, sum(least(h.w, r.w) * r.w) AS dot FROM w r JOIN w h ON h.item_id = r.item_id AND h.n = r.n AND h.g = r.g AND h.k = -1 WHERE r.k >= 0 GROUP BY ALL), "
    "x AS (SELECT r.item_id, r.k, r.n, coalesce(dot / (a.nn * r.nn), 0) * exp(-pow(len(t.h) - CASE r.k WHEN 0 THEN len(t.r0) ELSE len(t.r1) END, 2) / 72.0) AS sim FROM nn r JOIN nn a ON a.item_id = r.item_id AND a.n = r.n AND a.k = -1 JOIN t ON t.item_id = r.item_id LEFT JOIN dot ON dot.item_id = r.item_id AND dot.k = r.k AND dot.n = r.n WHERE r.k >= 0 AND r.nn > 0 AND a.nn > 0) "
    "SELECT t.item_id, round(coalesce(sum(sim), 0) / 2 / 4 * 10, 6) AS cider FROM t LEFT JOIN x ON x.item_id = t.item_id GROUP BY 1",
)
def cider(t: Tables) -> DataFrame:
    """CIDEr of each passage."""
    return C.cider(_captions(t), "item_id", "h", "rs").select("item_id", r6(F.col("cider")).alias("cider"))


@query(
    "rouge_l",
    f"WITH RECURSIVE c AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS h, b.w AS r FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1), "
    "m AS MATERIALIZED (SELECT x.conv_id, x.turn, i, j FROM (SELECT conv_id, turn, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS w FROM p) x JOIN (SELECT conv_id, turn, unnest(range(1, len(r) + 1)) AS j, unnest(r) AS w FROM p) y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.w = y.w), "
    "l(conv_id, turn, i, j, n) AS (SELECT conv_id, turn, i, j, 1 FROM m UNION SELECT l.conv_id, l.turn, m.i, m.j, n + 1 FROM l JOIN m ON m.conv_id = l.conv_id AND m.turn = l.turn AND m.i > l.i AND m.j > l.j), "
    "b AS (SELECT conv_id, turn, max(n) AS n FROM l GROUP BY ALL), f AS (SELECT p.conv_id, p.turn, coalesce(n, 0) / nullif(len(h), 0)::DOUBLE AS pr, coalesce(n, 0) / nullif(len(r), 0)::DOUBLE AS re FROM p LEFT JOIN b ON b.conv_id = p.conv_id AND b.turn = p.turn) "
    "SELECT conv_id, turn, round(CASE WHEN pr > 0 AND re > 0 THEN (1 + 1.44) * pr * re / (re + 1.44 * pr) ELSE 0.0 END, 6) AS rouge FROM f",
)
def rouge(t: Tables) -> DataFrame:
    """ROUGE-L of each turn against the turn before it."""
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.array("text").alias("rs"))
    return t.conversations.join(before, ["conv_id", "turn"]).select("conv_id", "turn", r6(C.rouge_l("text", "rs")).alias("rouge"))


@query("a31_external_metric", "SELECT item_id, round(length(replace(text, 'th', 'z')) / (length(text) * 2.0), 6) AS score FROM benchmark")
def external(t: Tables) -> DataFrame:
    """A metric from outside, here the lengths' quotient."""
    d = C.external_metric(_captions(t), "item_id", "h", "rs", lambda: lambda h, rs: len(h) / sum(map(len, rs)))
    return d.select("item_id", r6(F.col("score")).alias("score"))


@query("a33_aggregate", _GRAMS.replace("replace(text, chr(116) || chr(104), chr(122))", "text") + "x AS (SELECT count(*) AS n FROM t) SELECT n, true AS best FROM x")
def a33(t: Tables) -> DataFrame:
    """What the best epoch is chosen by: CIDEr plus BLEU-4, at its best where every caption is its own reference."""
    d = t.benchmark.select("item_id", F.col("text").alias("h"), F.array("text").alias("rs"))
    score = C.cider(d, "item_id", "h", "rs").agg(F.count("*").alias("n"), F.avg("cider").alias("cider"))
    whole = C.bleu(d, "item_id", "h", "rs").crossJoin(score)  # one row each
    return whole.select("n", (F.abs(C.caption_score(F.col("cider"), F.col("bleu4")) - 11.0) < 1e-6).alias("best"))


# --- retrieval in both directions -----------------------------------------------------------------------------------

_BOTH = (
    _DOUBLES + ", u AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM e), w AS (SELECT vec_id, label, list_concat(u[2:], u[1:1]) AS w FROM u), "
    "a AS (SELECT i.vec_id AS q, t.vec_id AS o, i.label = t.label AS gold, round(list_dot_product(u, w), 9) AS s FROM u i, w t WHERE i.vec_id % 100 = 0), b AS (SELECT t.vec_id AS q, i.vec_id AS o, i.label = t.label AS gold, round(list_dot_product(u, w), 9) AS s FROM u i, w t WHERE t.vec_id % 100 = 0), "
    "r AS (SELECT 'txt' AS d, q, gold, row_number() OVER (PARTITION BY q ORDER BY s DESC, o DESC) - 1 AS r FROM a UNION ALL SELECT 'img', q, gold, row_number() OVER (PARTITION BY q ORDER BY s DESC, o DESC) - 1 FROM b), "
    "k AS (SELECT d, q, coalesce(min(r) FILTER (gold), 1e9) AS rank FROM r GROUP BY ALL), x AS (SELECT d, avg((rank < 1)::INT::DOUBLE) * 100 AS r1, avg((rank < 5)::INT::DOUBLE) * 100 AS r5, avg((rank < 10)::INT::DOUBLE) * 100 AS r10 FROM k GROUP BY 1) "
)


@query(
    "m3_both_directions",
    _BOTH + "SELECT round(t.r1, 6) AS txt_r1, round(t.r5, 6) AS txt_r5, round(t.r10, 6) AS txt_r10, round((t.r1 + t.r5 + t.r10) / 3, 6) AS txt_r_mean, round(i.r1, 6) AS img_r1, round(i.r5, 6) AS img_r5, round(i.r10, 6) AS img_r10, round((i.r1 + i.r5 + i.r10) / 3, 6) AS img_r_mean, "
    "round(((t.r1 + t.r5 + t.r10) / 3 + (i.r1 + i.r5 + i.r10) / 3) / 2, 6) AS r_mean, round((t.r1 + t.r5 + t.r10) / 3, 6) AS agg_metrics FROM x t, x i WHERE t.d = 'txt' AND i.d = 'img'",
)
def m3_both(t: Tables) -> DataFrame:
    """Recalls from images to texts and back, a text's vector being its image's, turned by one place; one in a hundred of either asks, all answer (M3: J09, V01, V02, T02, T03)."""
    u = t.embeddings.select("vec_id", "label", V.normalise("embedding").alias("u"))
    w = u.select("vec_id", "label", F.concat(F.slice("u", 2, F.size("u") - 1), F.slice("u", 1, 1)).alias("u"))
    asks = lambda d: d.where("vec_id % 100 = 0")
    txt = M.recalls(B.gold_ranks(asks(u), w, others=False), prefix="txt_r")
    img = M.recalls(B.gold_ranks(asks(w), u, others=False), prefix="img_r")
    d = txt.crossJoin(img).withColumn("r_mean", (F.col("txt_r_mean") + F.col("img_r_mean")) / 2).withColumn("agg_metrics", F.col("txt_r_mean"))  # one row each
    return d.select(*[r6(F.col(c)).alias(c) for c in d.columns])


@query("t17_best_caption", "WITH s AS (SELECT o_custkey, o_orderkey, exp(o_totalprice / 1e5 - max(o_totalprice / 1e5) OVER w) AS e FROM orders WINDOW w AS (PARTITION BY o_custkey)), p AS (SELECT o_custkey, o_orderkey, e / sum(e) OVER (PARTITION BY o_custkey) AS p FROM s) SELECT o_custkey, o_orderkey, round(p, 6) AS p FROM p QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY round(p, 9) DESC, o_orderkey) = 1")
def t17(t: Tables) -> DataFrame:
    """The candidate of the largest softmax, the smaller one among equals."""
    from ..operators import masks as K

    d = K.group_softmax(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", F.col("o_totalprice") / 1e5, "p")
    top = M.best(d.withColumn("q", F.round("p", 9)), "o_custkey", "q", "o_orderkey")
    return top.join(d, ["o_custkey", "o_orderkey"]).select("o_custkey", "o_orderkey", r6(F.col("p")).alias("p"))


# --- maps ---------------------------------------------------------------------------------------------------------


@query(
    "m11_seen_map",
    _POINTS + ", m AS (SELECT x * cos(0.3 - pi() / 2) - y * sin(0.3 - pi() / 2) + 10 * 0.05 AS mx, x * sin(0.3 - pi() / 2) + y * cos(0.3 - pi() / 2) + 10 * 0.05 AS my, z + 0.88 AS mz FROM p WHERE NOT y > 0.2), "
    "c AS (SELECT round_even(mx / 0.05, 0)::INT AS cell_x, round_even(my / 0.05, 0)::INT AS cell_y, (mz >= 0.8)::INT + (mz >= 0.95)::INT AS b FROM m) SELECT cell_x, cell_y, max(CASE WHEN b = 1 THEN 2 ELSE 1 END)::INT AS value FROM c WHERE b <= 1 AND cell_x BETWEEN 0 AND 19 AND cell_y BETWEEN 0 AND 19 GROUP BY ALL",
)
def m11_seen(t: Tables) -> DataFrame:
    """From camera points to the map of what is seen (M11: P12, V11, V12, V13, V16, A17)."""
    return P.seen_map(_points(t), "x", "y", "z", F.lit(0.3), F.lit(10), F.lit(10), 0.88, 20, 0.05, [0.8, 0.95], 0.2)


@query("v27_weighted_attention", "WITH a AS (SELECT s_suppkey, [(s_suppkey % 7) / 10.0::DOUBLE, (s_suppkey % 5) / 10.0::DOUBLE] AS a0, [(s_suppkey % 3) / 10.0::DOUBLE, 0.5::DOUBLE] AS a1, [(s_suppkey % 4) - 1.5::DOUBLE, 1.0::DOUBLE] AS g0, [0.25::DOUBLE, (s_suppkey % 6) - 2.0::DOUBLE] AS g1 FROM supplier) SELECT s_suppkey, round((a0[1] * greatest(g0[1], 0) + a1[1] * greatest(g1[1], 0)) / 2, 6) AS w0, round((a0[2] * greatest(g0[2], 0) + a1[2] * greatest(g1[2], 0)) / 2, 6) AS w1 FROM a")
def v27(t: Tables) -> DataFrame:
    """Attention of two heads weighted by the positive part of its gradient."""
    m = lambda n: (F.col("s_suppkey") % n).cast("double")
    d = t.supplier.select("s_suppkey", F.array(F.array(m(7) / 10, m(5) / 10), F.array(m(3) / 10, F.lit(0.5))).alias("a"), F.array(F.array(m(4) - 1.5, F.lit(1.0)), F.array(F.lit(0.25), m(6) - 2)).alias("g"))
    d = d.withColumn("w", V.weighted_attention("a", "g"))
    return d.select("s_suppkey", r6(F.get("w", 0)).alias("w0"), r6(F.get("w", 1)).alias("w1"))


@query("v19_voxel_code", "SELECT c_custkey, round(0.01 * sin((c_custkey % 256)::DOUBLE), 6) AS x0, round(0.01 * cos((c_nationkey) / pow(10000.0, 2 / 8.0)), 6) AS y3, round(0.01 * sin((c_custkey % 17) / pow(10000.0, 6 / 8.0)), 6) AS z6 FROM customer")
def v19_voxels(t: Tables) -> DataFrame:
    """The codes of three axes one after the other."""
    d = t.customer.select("c_custkey", V.voxel_code(F.col("c_custkey") % 256, F.col("c_nationkey"), F.col("c_custkey") % 17, 8).alias("v"))
    return d.select("c_custkey", r6(F.get("v", 0)).alias("x0"), r6(F.get("v", 8 + 3)).alias("y3"), r6(F.get("v", 16 + 6)).alias("z6"))


@query("g12_boxes", "SELECT s_suppkey, s_suppkey % 2 = 0 AS nested, (s_suppkey % 10)::DOUBLE AS x0, (s_suppkey % 10 + 3)::DOUBLE AS x1 FROM supplier")
def g12(t: Tables) -> DataFrame:
    """Boxes written as six numbers or as two triples."""
    k = (F.col("s_suppkey") % 10).cast("string")
    k3 = (F.col("s_suppkey") % 10 + 3).cast("string")
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("[["), k, F.lit(",1,2],["), k3, F.lit(",4,5]]"))).otherwise(F.concat(F.lit("["), k, F.lit(",1,2,"), k3, F.lit(",4,5]")))
    d = t.supplier.select("s_suppkey", G.box_corners(text).alias("b"))
    return d.select("s_suppkey", (F.col("s_suppkey") % 2 == 0).alias("nested"), F.get(F.get("b", 0), 0).alias("x0"), F.get(F.get("b", 1), 0).alias("x1"))


# --- images -------------------------------------------------------------------------------------------------------

_SIDE = 8
_PIXELS = f"WITH p AS (SELECT s_suppkey, y, x, c, ((s_suppkey * 31 + y * 17 + x * 7 + c * 3) % 256)::INT AS v FROM supplier, (SELECT unnest(range(0, {_SIDE})) AS y), (SELECT unnest(range(0, {_SIDE})) AS x), (SELECT unnest(range(0, 3)) AS c)) "


def _images(t: Tables) -> DataFrame:
    """An image of 8 x 8 for each supplier, made from its number."""
    place = F.sequence(F.lit(0), F.lit(_SIDE * _SIDE * 3 - 1))
    value = lambda i: F.pmod(F.col("s_suppkey") * 31 + F.floor(i / (3 * _SIDE)) * 17 + F.floor(i / 3) % _SIDE * 7 + i % 3 * 3, F.lit(256))
    pixels = F.unhex(F.array_join(F.transform(place, lambda i: F.lpad(F.hex(value(i)), 2, "0")), ""))
    return t.supplier.select("s_suppkey", F.lit(_SIDE).alias("height"), F.lit(_SIDE).alias("width"), F.lit(3).alias("channels"), pixels.alias("pixels"))


def _digest(d: DataFrame) -> DataFrame:
    """(s_suppkey, bytes in hexadecimal)."""
    return d.select("s_suppkey", "height", "width", F.lower(F.hex("pixels")).alias("pixels"))


@query(
    "v29_crop_resize_flip",
    _PIXELS + ", k AS (SELECT s_suppkey, y, x, c, v FROM p WHERE y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 5), r AS (SELECT s_suppkey, o.y, 7 - o.x AS x, c, v FROM k JOIN (SELECT y, x, y * 6 // 12 + 1 AS sy, x * 4 // 8 + 2 AS sx FROM (SELECT unnest(range(0, 12)) AS y), (SELECT unnest(range(0, 8)) AS x)) o ON k.y = o.sy AND k.x = o.sx) "
    "SELECT s_suppkey, 12::INT AS height, 8::INT AS width, string_agg(lpad(lower(hex(v)), 2, '0'), '' ORDER BY y, x, c) AS pixels FROM r GROUP BY 1",
)
def v29(t: Tables) -> DataFrame:
    """Middle crop, resize and mirror image."""
    return _digest(A.prepare(_images(t), "s_suppkey", (6, 4), (12, 8), mirrored=True))


@query("v29_normalise", _PIXELS + f"SELECT s_suppkey, (y * {_SIDE * 3} + x * 3 + c)::INT AS place, round((v / 255.0 - [0.5, 0.4, 0.3][c + 1]) / [0.2, 0.25, 0.3][c + 1], 6) AS value FROM p")
def v29_values(t: Tables) -> DataFrame:
    """Pixels less the mean over the deviation of their channel."""
    d = A.normalised(_images(t), "s_suppkey", [0.5, 0.4, 0.3], [0.2, 0.25, 0.3])
    return d.select("s_suppkey", F.posexplode("values").alias("place", "value")).withColumn("value", r6(F.col("value")))


_POINTWISE = ("Identity", "Solarize", "Posterize", "Brightness")


def _drawn(k: int) -> str:
    name = f"floor({_uniform_sql('s_suppkey', str(k), chr(39) + 'name' + chr(39))} * 4)::INT"
    return f"CASE WHEN {_uniform_sql('s_suppkey', str(k), chr(39) + 'take' + chr(39))} < 0.5 THEN {name} ELSE 0 END"


def _applied(op: str, v: str) -> str:
    return f"CASE {op} WHEN 1 THEN CASE WHEN {v} < 128 THEN {v} ELSE 255 - {v} END WHEN 2 THEN {v} & 192 WHEN 3 THEN floor(least(255, {v} * 1.0))::INT ELSE {v} END"


@query(
    "v30_augment",
    _PIXELS + f", o AS (SELECT s_suppkey, {_drawn(0)} AS a, {_drawn(1)} AS b FROM supplier), f AS (SELECT s_suppkey, y, x, c, b, {_applied('a', 'v')} AS v FROM p JOIN o USING (s_suppkey)), g AS (SELECT s_suppkey, y, x, c, {_applied('b', 'v')} AS v FROM f) "
    f"SELECT s_suppkey, {_SIDE}::INT AS height, {_SIDE}::INT AS width, string_agg(lpad(lower(hex(v)), 2, '0'), '' ORDER BY y, x, c) AS pixels FROM g GROUP BY 1",
)
def v30(t: Tables) -> DataFrame:
    """Two random operations an image, of those that change each pixel by itself, at half strength."""
    return _digest(A.augment(_images(t), "s_suppkey", 2, 5, 10, _POINTWISE))


@query("v30_augment_all")
def v30_all(t: Tables) -> DataFrame:
    """Three random operations of all fourteen on every image."""
    return _digest(A.augment(_images(t), "s_suppkey", 3))


_GREYS = "(c0 * 0.114::DOUBLE + c1 * 0.587::DOUBLE + c2 * 0.299::DOUBLE)"
_CUT = "least(255, greatest(0, {}))"
_EACH = {
    "auto_contrast": "CASE WHEN hi > lo THEN floor((v - lo)::DOUBLE * 255 / (hi - lo)) ELSE v END",
    "brightness": "floor(" + _CUT.format("v * 1.3::DOUBLE") + ")",
    "colour": "floor(" + _CUT.format(f"{_GREYS} + 0.5::DOUBLE * (v - {_GREYS})") + ")",
    "contrast": "floor(" + _CUT.format("(v - mean) * 0.5::DOUBLE + mean") + ")",
    "cutout": "CASE WHEN x BETWEEN 1 AND 4 AND y BETWEEN 0 AND 3 THEN 128 ELSE v END",
    "invert": "255 - v",
    "posterize": "v & 224",
    "sharpness": "CASE WHEN around IS NULL THEN v ELSE floor(" + _CUT.format("around + 1.5::DOUBLE * (v - around)") + ") END",
    "solarize": "CASE WHEN v < 100 THEN v ELSE 255 - v END",
}


@query(
    "v30_each_operation",
    _PIXELS
    + ", a AS (SELECT s_suppkey, c, min(v) AS lo, max(v) AS hi, avg(v)::DOUBLE AS m FROM p GROUP BY ALL), g AS (SELECT s_suppkey, sum(m * [0.114::DOUBLE, 0.587::DOUBLE, 0.299::DOUBLE][c + 1] ORDER BY c) AS mean FROM a GROUP BY 1), "
    "k AS (SELECT s_suppkey, y, x, max(v) FILTER (c = 0) AS c0, max(v) FILTER (c = 1) AS c1, max(v) FILTER (c = 2) AS c2 FROM p GROUP BY ALL), "
    "n AS (SELECT p.s_suppkey, p.y, p.x, p.c, round_even((sum(q.v) + 4 * any_value(p.v)) / 13.0::DOUBLE, 0) AS around FROM p JOIN p q ON q.s_suppkey = p.s_suppkey AND q.c = p.c AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL HAVING count(*) = 9), "
    "w AS (SELECT p.*, lo, hi, mean, c0, c1, c2, around FROM p JOIN a USING (s_suppkey, c) JOIN g USING (s_suppkey) JOIN k USING (s_suppkey, y, x) LEFT JOIN n USING (s_suppkey, y, x, c)), "
    "o AS (" + " UNION ALL ".join(f"SELECT s_suppkey, y, x, c, '{name}' AS operation, ({sql})::INT AS v FROM w" for name, sql in _EACH.items()) + ") "
    f"SELECT s_suppkey, operation, {_SIDE}::INT AS height, {_SIDE}::INT AS width, string_agg(lpad(lower(hex(v)), 2, '0'), '' ORDER BY y, x, c) AS pixels FROM o GROUP BY 1, 2",
)
def v30_each(t: Tables) -> DataFrame:
    """Nine operations by themselves, each on every image."""
    from ..functions import images as I

    each = {
        "auto_contrast": I.auto_contrast, "brightness": lambda a: I.brightness(a, 1.3), "colour": lambda a: I.colour(a, 0.5), "contrast": lambda a: I.contrast(a, 0.5), "cutout": lambda a: I.cutout(a, 4, 3, 2),
        "invert": I.invert, "posterize": lambda a: I.posterize(a, 3), "sharpness": lambda a: I.sharpness(a, 1.5), "solarize": lambda a: I.solarize(a, 100),
    }
    out = None
    for name, f in each.items():
        d = _digest(A.map_images(_images(t), lambda a, _, f=f: f(a), "s_suppkey")).withColumn("operation", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


@query("v32_polygon_cells", "SELECT s_suppkey, y::INT AS y, x::INT AS x FROM supplier, (SELECT unnest(range(0, 16)) AS y), (SELECT unnest(range(0, 16)) AS x) WHERE x + 0.5 > s_suppkey % 5 + 0.2 AND x + 0.5 < s_suppkey % 7 + 6.7 AND y + 0.5 > s_suppkey % 3 + 0.3 AND y + 0.5 < s_suppkey % 4 + 8.8")
def v32(t: Tables) -> DataFrame:
    """Cells inside of polygons, here boxes with corners between the cells."""
    k = F.col("s_suppkey")
    x0, x1, y0, y1 = k % 5 + 0.2, k % 7 + 6.7, k % 3 + 0.3, k % 4 + 8.8
    d = t.supplier.select("s_suppkey", F.array(*[c.cast("double") for c in (x0, y0, x1, y0, x1, y1, x0, y1)]).alias("polygon"))
    return A.polygon_cells(d, "s_suppkey", "polygon", 16, 16)


# --- tokens -------------------------------------------------------------------------------------------------------


@query("f23_word_tokens")
def f23_tokens(t: Tables) -> DataFrame:
    """Every turn as 77 ids of the public tokenizer with word ends."""
    import public_tokenizers

    from ..functions.text import clean_text
    from ..operators import word_tokens

    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return word_tokens.fixed(t.conversations.select(key.alias("key"), clean_text("text").alias("text")), "key", "text", str(public_tokenizers.path("word_bpe_49k.json")))


@query("f22_any_entities", "SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || ' é & <b> ½ café' AS clean FROM conversations")
def f22_any(t: Tables) -> DataFrame:
    """Every named and numbered entity, twice, and wrongly read UTF-8."""
    from ..functions.text import clean_any_text

    d = t.conversations.select("conv_id", "turn", clean_any_text("text").alias("a"), clean_any_text(F.lit(" &eacute; &amp;amp; &lt;B&gt; &#189; caf&amp;eacute;")).alias("b"))
    return d.select("conv_id", "turn", F.concat_ws(" ", "a", "b").alias("clean"))


@query("f22_repaired", "SELECT n_nationkey, 'café ' || lower(n_name) AS clean FROM nation")
def f22_repaired(t: Tables) -> DataFrame:
    """UTF-8 that was read as Windows' Western code page."""
    from ..functions.text import clean_any_text

    return t.nation.select("n_nationkey", clean_any_text(F.concat(F.lit("cafÃ© "), "n_name")).alias("clean"))


@query("f26_lemmas", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: rtrim(w, 's')), ' ') AS lemmas FROM part")
def f26(t: Tables) -> DataFrame:
    """Words by an injected lemmatiser, here one that drops the last s."""
    from ..operators import scorers

    return scorers.lemmas(t.part.select("p_partkey", "p_name"), "p_name", lambda: lambda w: w.rstrip("s")).select("p_partkey", "lemmas")


@query(
    "v33_padded_batch",
    _PIXELS + ", z AS (SELECT s_suppkey, y, x, c, v, 3 + s_suppkey % 4 AS h, 2 + s_suppkey % 5 AS w, s_suppkey // 4 AS b FROM p), k AS (SELECT * FROM z WHERE y < h AND x < w), m AS (SELECT b, max(h) AS mh, max(w) AS mw FROM z GROUP BY 1) "
    "SELECT s_suppkey, mh::INT AS height, mw::INT AS width, sum(v * ((y * mw + x) * 3 + c + 1))::BIGINT AS digest, (mh * mw - max(h) * max(w))::BIGINT AS filled FROM k JOIN m USING (b) GROUP BY s_suppkey, mh, mw",
)
def v33(t: Tables) -> DataFrame:
    """Images of different sizes, four to a batch, filled up to the largest of it."""
    import numpy as np

    def cut(a, k):
        return a[: 3 + int(k) % 4, : 2 + int(k) % 5]

    d = A.map_images(_images(t), cut, "s_suppkey").withColumn("b", F.floor(F.col("s_suppkey") / 4))
    d = A.padded(d, "b", "s_suppkey")

    def digest(batches):
        for b in batches:
            sums = [int((np.frombuffer(p, np.uint8).astype(np.int64) * np.arange(1, len(p) + 1)).sum()) for p in b["pixels"]]
            yield b[["s_suppkey", "height", "width"]].assign(digest=sums, filled=[int(np.frombuffer(m, np.uint8).sum()) for m in b["mask"]])

    return d.mapInPandas(digest, "s_suppkey long, height int, width int, digest long, filled long")
