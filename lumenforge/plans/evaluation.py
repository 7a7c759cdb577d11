"""Registered queries of evaluation that compare boxes, captions and vectors across rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import heatmaps as H
from ..functions import strided as S
from ..functions import vectors as V
from ..operators import blocks as B
from ..operators import detection as E
from ..operators import meteor as O
from .catalog import _RANKED, Tables, query, r6

_BOXES_SQL = """
WITH RECURSIVE b AS (SELECT l_orderkey AS image_id, l_returnflag AS class, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, 20 + l_quantity::DOUBLE AS w, 10 + 5 * l_linenumber::DOUBLE AS h, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem),
t AS (SELECT image_id, class, id AS truth_id, x, y, w, h, p % 17 = 0 AS crowd FROM b WHERE n % 4 <> 0),
d AS (SELECT image_id, class, id AS det_id, x + s % 7 AS x, y + image_id % 5 AS y, w, h + p % 3 AS h, ((p * 7 + s * 13 + n) % 1000) / 1000.0::DOUBLE AS score FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, class ORDER BY score DESC, det_id) AS k FROM d),
i AS (SELECT r.image_id, r.class, r.k, t.truth_id, t.crowd, greatest(0, least(r.x + r.w, t.x + t.w) - greatest(r.x, t.x)) * greatest(0, least(r.y + r.h, t.y + t.h) - greatest(r.y, t.y)) AS i, r.w * r.h AS a, t.w * t.h AS c FROM r JOIN t USING (image_id, class)),
o AS (SELECT image_id, class, k, truth_id, crowd, i / CASE WHEN crowd THEN a ELSE a + c - i END AS iou FROM i),
near AS (SELECT image_id, class, k, list({'crowd': crowd, 'iou': iou, 'id': truth_id} ORDER BY crowd, iou DESC, truth_id DESC) AS near FROM o WHERE iou >= 0.5 GROUP BY ALL),
v AS (SELECT r.image_id, r.class, r.k, r.det_id, r.score, coalesce(near, []) AS near FROM r LEFT JOIN near USING (image_id, class, k)),
m AS (SELECT image_id, class, thr, 0::BIGINT AS k, NULL::BIGINT AS det_id, NULL::DOUBLE AS score, NULL::BIGINT AS hit, false AS crowd, []::BIGINT[] AS gone FROM (SELECT DISTINCT image_id, class FROM r), (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS thr)
  UNION ALL SELECT image_id, class, thr, k, det_id, score, f[1].id, coalesce(f[1].crowd, false), CASE WHEN f[1].crowd = false THEN list_append(gone, f[1].id) ELSE gone END
  FROM (SELECT m.image_id, m.class, m.thr, v.k, v.det_id, v.score, m.gone, list_filter(v.near, lambda c: c.iou >= m.thr AND (c.crowd OR NOT list_contains(m.gone, c.id))) AS f FROM m JOIN v ON v.image_id = m.image_id AND v.class = m.class AND v.k = m.k + 1)),
pos AS (SELECT class, count(*) AS positives FROM t WHERE NOT crowd GROUP BY 1)
"""


def _boxes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """True boxes and detections of an image for each order, made of its lines: some truths are crowds, some detections have none."""
    b = t.lineitem.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("class"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("id"),
        (F.col("l_partkey") % 40).cast("double").alias("x"), (F.col("l_suppkey") % 40).cast("double").alias("y"), (F.lit(20) + F.col("l_quantity").cast("double")).alias("w"), (F.lit(10) + 5 * F.col("l_linenumber").cast("double")).alias("h"),
        F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"),
    )
    truths = b.where("n % 4 <> 0").select("image_id", "class", F.col("id").alias("truth_id"), F.struct("x", "y", "w", "h").alias("box"), (F.col("p") % 17 == 0).alias("crowd"))
    box = F.struct((F.col("x") + F.col("s") % 7).alias("x"), (F.col("y") + F.col("image_id") % 5).alias("y"), "w", (F.col("h") + F.col("p") % 3).alias("h"))
    return b.select("image_id", "class", F.col("id").alias("det_id"), (((F.col("p") * 7 + F.col("s") * 13 + F.col("n")) % 1000) / 1000).alias("score"), box.alias("box")), truths


@query(
    "a32_detection_matches",
    _BOXES_SQL + "SELECT class, thr AS threshold, count(*) AS n, count(hit) FILTER (NOT crowd) AS hits, count(hit) FILTER (crowd) AS ignored FROM m WHERE k > 0 GROUP BY 1, 2",
)
def a32_matches(t: Tables) -> DataFrame:
    """Greedy matching of detections by class and threshold."""
    m = E.by_threshold(E.match_detections(*_boxes(t)))
    return m.groupBy("class", "threshold").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if("ignored").alias("ignored"))


@query(
    "a32_detection_ap",
    _BOXES_SQL
    + """, c AS (SELECT class, thr, sum((hit IS NOT NULL)::INT) OVER o AS tp, row_number() OVER o AS n FROM m WHERE k > 0 AND NOT crowd WINDOW o AS (PARTITION BY class, thr ORDER BY score DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
q AS (SELECT class, thr, tp / positives::DOUBLE AS recall, tp / n::DOUBLE AS precision FROM c JOIN pos USING (class)),
g AS (SELECT class, thr, step, (SELECT max(precision) FROM q WHERE q.class = x.class AND q.thr = x.thr AND q.recall >= step * 0.01::DOUBLE) AS p FROM (SELECT class, thr, unnest(range(0, 101)) AS step FROM pos, (SELECT DISTINCT thr FROM m)) x),
ap AS (SELECT class, thr, avg(coalesce(p, 0)) AS ap FROM g GROUP BY 1, 2), ar AS (SELECT class, thr, max(recall) AS ar FROM q GROUP BY 1, 2)
SELECT metric, round(value, 6) AS value FROM (SELECT 'AP' AS metric, avg(ap) * 100 AS value FROM ap UNION ALL SELECT 'AP50', avg(ap) * 100 FROM ap WHERE thr = 0.5 UNION ALL SELECT 'AP75', avg(ap) * 100 FROM ap WHERE thr = 0.75
  UNION ALL SELECT 'AR', avg(ar) * 100 FROM ar UNION ALL SELECT 'AP-' || class, avg(ap) * 100 FROM ap GROUP BY class)""",
)
def a32_ap(t: Tables) -> DataFrame:
    """AP, AP50, AP75, AR and AP of each class."""
    return E.evaluate(*_boxes(t)).withColumn("value", r6(F.col("value")))


@query("d05_split_top_k", _RANKED + "SELECT q, i, s FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, i) <= 10")
def d05(t: Tables) -> DataFrame:
    """The ten nearest of one vector in a hundred among all, by products of blocks."""
    e = t.embeddings.select("vec_id", V.normalise("embedding").alias("u"))
    return B.split_top_k(e.where("vec_id % 100 = 0"), e, 10).select("q", "i", "s")


_METEOR_SQL = """WITH RECURSIVE p AS (SELECT p_partkey AS k, lower(p_name) AS n, lower(p_type) AS y FROM part),
c AS (SELECT a.k, string_split(a.n || ' ' || b.n || ' ' || a.y, ' ') AS h, string_split(b.n || ' ' || b.y || ' ' || a.n, ' ') AS r FROM p a JOIN p b ON b.k = a.k + 1),
s(k, i, last, used, m, ch) AS (SELECT k, 0, -2, []::BIGINT[], 0, 0 FROM c
  UNION ALL SELECT s.k, s.i + 1, o.j, CASE WHEN o.j >= 0 THEN list_append(s.used, o.j) ELSE s.used END, s.m + (o.j >= 0)::INT, s.ch + (o.j >= 0 AND o.j <> s.last + 1)::INT
  FROM s JOIN c ON c.k = s.k AND s.i < len(c.h) CROSS JOIN LATERAL (SELECT -2 AS j UNION ALL SELECT unnest(list_filter(range(0, len(c.r)), lambda x: c.r[x + 1] = c.h[s.i + 1] AND NOT list_contains(s.used, x)))) o),
e AS (SELECT s.k, m, ch, len(h) AS nh, len(r) AS nr FROM s JOIN c ON c.k = s.k WHERE s.i = len(h) QUALIFY row_number() OVER (PARTITION BY s.k ORDER BY m DESC, ch) = 1)
SELECT k AS p_partkey, round(CASE WHEN m = 0 THEN 0 ELSE (m / nh::DOUBLE) * (m / nr::DOUBLE) / (0.9::DOUBLE * (m / nh::DOUBLE) + 0.1::DOUBLE * (m / nr::DOUBLE)) * (1 - 0.5::DOUBLE * (ch / m::DOUBLE) ** 3) END, 6) AS meteor FROM e"""


@query("a31_meteor", _METEOR_SQL)
def a31_meteor(t: Tables) -> DataFrame:
    """METEOR of short captions made of neighbouring parts, equal words only; the SQL goes through all alignments."""
    name, kind = F.lower("p_name"), F.lower("p_type")
    a = t.part.select("p_partkey", name.alias("n"), kind.alias("y"))
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), name.alias("n2"), kind.alias("y2"))
    d = a.join(b, "p_partkey").select("p_partkey", F.concat_ws(" ", "n", "n2", "y").alias("h"), F.array(F.concat_ws(" ", "n2", "y2", "n")).alias("rs"))
    return O.meteor(d, "p_partkey", "h", "rs", stages=("exact",)).withColumn("meteor", r6(F.col("meteor")))


_GRID_SQL = """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN list_max(e) > list_min(e) THEN (x - list_min(e)) / (list_max(e) - list_min(e)) ELSE 0 END) AS e FROM g),
c AS (SELECT k::INT AS k, least(greatest((k + 0.5::DOUBLE) * 8 / 12 - 0.5::DOUBLE, 0), 7) AS x FROM (SELECT unnest(range(0, 12)) AS k)), a AS (SELECT k, floor(x)::INT AS a, least(floor(x)::INT + 1, 7) AS b, x - floor(x) AS t FROM c),
z AS (SELECT vec_id, y.k AS y, x.k AS x, (e[8 * y.a + x.a + 1] * (1 - x.t) + e[8 * y.a + x.b + 1] * x.t) * (1 - y.t) + (e[8 * y.b + x.a + 1] * (1 - x.t) + e[8 * y.b + x.b + 1] * x.t) * y.t AS v FROM s, a y, a x)"""


@query("v28_resize", _GRID_SQL + " SELECT vec_id, y, x, round(v, 6) + 0.0 AS value FROM z")
def v28_resize(t: Tables) -> DataFrame:
    """Attention grids of 8 x 8, stretched and resized to 12 x 12."""
    g = H.resize(H.stretch(F.transform("embedding", lambda x: x.cast("double"))), 8, 8, 12, 12)
    d = t.embeddings.select("vec_id", F.posexplode(g).alias("p", "v"))
    return d.select("vec_id", F.floor(F.col("p") / 12).cast("int").alias("y"), (F.col("p") % 12).alias("x"), r6(F.col("v")).alias("value"))


@query(
    "v28_blur",
    """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), d AS (SELECT unnest(range(-4, 5)) AS d), w AS (SELECT d, exp(-0.5::DOUBLE * d * d) / (SELECT sum(exp(-0.5::DOUBLE * d * d)) FROM d) AS w FROM d),
n AS (SELECT k, CASE WHEN m < 8 THEN m ELSE 15 - m END AS q, w FROM (SELECT k, ((k + d) % 16 + 16) % 16 AS m, w FROM w, (SELECT unnest(range(0, 8)) AS k))),
f AS (SELECT vec_id, k AS y, x, sum(w * e[8 * q + x + 1]) AS v FROM g, n, (SELECT unnest(range(0, 8)) AS x) GROUP BY ALL) SELECT vec_id, y::INT AS y, k::INT AS x, round(sum(w * v), 5) + 0.0 AS value FROM f JOIN n ON n.q = f.x GROUP BY ALL""",
)
def v28_blur(t: Tables) -> DataFrame:
    """Gaussian blur of the grids, mirrored at the border."""
    g = H.blur(F.transform("embedding", lambda x: x.cast("double")), 8, 8, 1.0)
    d = t.embeddings.select("vec_id", F.posexplode(g).alias("p", "v"))
    return d.select("vec_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), (F.round("v", 5) + 0.0).alias("value"))


@query(
    "v31_video_views",
    "WITH p AS (SELECT vec_id, embedding AS e, t, y, x, c FROM embeddings, (SELECT unnest([0, 1]) AS t), (SELECT unnest([0, 1]) AS y), (SELECT unnest([0, 1, 2]) AS x), (SELECT unnest([0, 1]) AS c)) "
    "SELECT vec_id, (((t * 2 + y) * 3 + x) * 2 + c)::INT AS place, round(((e[c * 32 + t * 16 + (y + 1) * 4 + (3 - x) + 1]::DOUBLE / 255) - [0.5, 0.25][c + 1]) / [0.5, 2.0][c + 1], 6) + 0.0 AS value FROM p",
)
def v31(t: Tables) -> DataFrame:
    """Clips of two channels, two frames of 4 x 4: cropped, mirrored, axes from CTHW to THWC, normalised by channel."""
    clip = S.view(F.transform("embedding", lambda x: x.cast("double")), [2, 2, 4, 4])
    seen = S.permute(S.crop(S.flip(clip, 3, 4), [0, 0, 1, 0], [2, 2, 2, 3]), [1, 2, 3, 0])
    d = t.embeddings.select("vec_id", F.posexplode(S.normalise(seen, 3, 4, [0.5, 0.25], [0.5, 2.0])).alias("place", "v"))
    return d.select("vec_id", "place", r6(F.col("v")).alias("value"))
