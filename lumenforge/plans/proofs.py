"""Registered queries of operators that other queries don't call, or call on constants only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import vectors as V
from ..operators import captions as C
from ..operators import dedup as D
from ..operators import masks as K
from ..operators import metrics as M
from ..operators import sampling as S
from ..runtime import scratch
from ..sources import image_sets as I
from ..sources import readers as R
from ..sources import sinks
from . import config
from .catalog import _DOUBLES, ORACLES, Tables, _seeded_sql, _uniform_sql, query, r6
from .measures import _captions


@query(
    "a27_semantic_map",
    "WITH c AS (SELECT l_suppkey % 50 AS q, l_returnflag AS label, avg(l_discount) AS cp FROM lineitem GROUP BY ALL), m AS (SELECT o_custkey % 50 AS q, o_orderkey % 16 AS x, o_orderkey // 16 % 8 AS y, avg(o_totalprice) / 1e6 AS mp FROM orders GROUP BY ALL) "
    "SELECT x, y, label, round(sum(cp * mp), 6) AS score FROM c JOIN m USING (q) GROUP BY ALL",
)
def a27_map(t: Tables) -> DataFrame:
    """Class times mask probabilities over queries, for each pixel and label."""
    classes = t.lineitem.groupBy((F.col("l_suppkey") % 50).alias("q"), F.col("l_returnflag").alias("label")).agg(F.avg("l_discount").alias("cp"))
    masks = t.orders.groupBy((F.col("o_custkey") % 50).alias("q"), (F.col("o_orderkey") % 16).alias("x"), (F.floor(F.col("o_orderkey") / 16) % 8).alias("y")).agg((F.avg("o_totalprice") / 1e6).alias("mp"))
    return K.semantic_scores(classes, masks, "q", "label", ["x", "y"], "cp", "mp").select("x", "y", "label", r6(F.col("score")).alias("score"))


@query("k03_leaderboard_map", "SELECT doc_id::VARCHAR AS id, quality::VARCHAR AS answer FROM labels WHERE quality IS NOT NULL")
def k03(t: Tables) -> DataFrame:
    """The leaderboard's one document, an answer by id, written and read back."""
    path = scratch(t.spark, "board")
    board = sinks.leaderboard_map(t.labels.where("quality is not null").withColumn("answer", F.col("quality").cast("string")), "doc_id", "answer")
    board.coalesce(1).write.json(path)
    return t.spark.read.schema("answers map<string,string>").json(path).select(F.explode("answers").alias("id", "answer"))


@query("u06_ratio_problems", "SELECT coalesce(d.lang, r.lang) AS name, CASE WHEN r.lang IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) d FULL JOIN (VALUES ('en'), ('xx')) r(lang) ON r.lang = d.lang WHERE d.lang IS NULL OR r.lang IS NULL")
def u06(t: Tables) -> DataFrame:
    """Sources without a ratio and ratios without a source."""
    return D.ratio_problems(t.documents, "lang", {"en": 2.0, "xx": 1.0})


@query("a33_caption_score", f"SELECT round(a.c + b.bleu4, 4) AS score FROM (SELECT avg(cider) AS c FROM ({ORACLES['cider_captions']})) a, (SELECT bleu4 FROM ({ORACLES['bleu_captions']})) b")
def a33_score(t: Tables) -> DataFrame:
    """CIDEr plus BLEU-4 of changed captions."""
    d = _captions(t)
    cider = C.cider(d, "item_id", "h", "rs").agg(F.avg(r6(F.col("cider"))).alias("cider"))
    both = cider.crossJoin(C.bleu(d, "item_id", "h", "rs").select(r6(F.col("bleu4")).alias("bleu4")))  # one row each
    return both.select(F.round(C.caption_score(F.col("cider"), F.col("bleu4")), 4).alias("score"))


_SPEC = {"model.size": {"type": "long"}, "model.kind": {"choices": ["ECONOMY", "STANDARD", "PROMO"]}, "lr": {"type": "double"}}


@query(
    "f28_settings_of_rows",
    """WITH s AS (SELECT p_partkey, unnest(['model.size=' || p_size, 'model.kind=' || p_type, 'lr=' || CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '0.5' END, CASE WHEN p_partkey % 3 = 0 THEN 'lr=0.25' ELSE 'extra=' || p_brand END]) AS a, unnest([0, 1, 2, 3]) AS k FROM part),
n AS (SELECT p_partkey, split_part(a, '=', 1) AS name, substr(a, strpos(a, '=') + 1) AS value, k FROM s), l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY p_partkey, name ORDER BY k DESC) = 1)
SELECT p_partkey, name, value, CASE WHEN name = 'extra' THEN 'unknown key' WHEN name = 'model.kind' AND value NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'not a choice' WHEN name = 'lr' AND try_cast(value AS DOUBLE) IS NULL THEN 'not a double' END AS problem FROM l""",
)
def f28_rows(t: Tables) -> DataFrame:
    """Dotted settings of every row, the later of a name wins, checked against a description."""
    words = F.array(
        F.concat(F.lit("model.size="), F.col("p_size").cast("string")), F.concat(F.lit("model.kind="), "p_type"), F.concat(F.lit("lr="), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise("0.5")), F.when(F.col("p_partkey") % 3 == 0, F.lit("lr=0.25")).otherwise(F.concat(F.lit("extra="), "p_brand"))
    )
    return config.checked_rows(t.part.select("p_partkey", words.alias("words")), "words", _SPEC).select("p_partkey", "name", "value", "problem")


@query("v07_box_centres", "SELECT o_custkey, round_even((min(o_orderkey % 512) / 8.0::DOUBLE + max(o_orderkey % 512) / 8.0::DOUBLE) / 2, 3) AS x, round_even((min(o_orderkey % 300) / 8.0::DOUBLE + max(o_orderkey % 300) / 8.0::DOUBLE) / 2, 3) AS y FROM orders GROUP BY 1")
def v07(t: Tables) -> DataFrame:
    """Centres of boxes, rounded half to even."""
    d = t.orders.withColumn("x", F.col("o_orderkey") % 512 / 8).withColumn("y", F.col("o_orderkey") % 300 / 8)
    return d.groupBy("o_custkey").agg(*[G.box_centre(F.min(c), F.max(c)).alias(c) for c in "xy"])


@query(
    "v20_quantise_symmetric",
    _DOUBLES + ", x AS (SELECT vec_id, (p - 1) // 32 AS g, p, x FROM (SELECT vec_id, unnest(range(1, len(v) + 1)) AS p, unnest(v) AS x FROM e)), s AS (SELECT vec_id, g, CASE WHEN max(abs(x)) > 0 THEN 127 / max(abs(x)) ELSE 0 END AS scale FROM x GROUP BY ALL) "
    "SELECT vec_id, g::INT AS g, round(any_value(scale), 6) AS scale, sum(round_even(least(127, greatest(-127, x * scale)), 0))::BIGINT AS total, max(abs(round_even(x * scale, 0)))::INT AS most FROM x JOIN s USING (vec_id, g) GROUP BY ALL",
)
def v20_symmetric(t: Tables) -> DataFrame:
    """Signed quantisation by groups."""
    d = t.embeddings.select("vec_id", F.posexplode(V.quantise_symmetric(V.doubles("embedding"), 32)).alias("g", "s"))
    total = F.aggregate("s.q", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("vec_id", "g", r6(F.col("s.scale")).alias("scale"), total.alias("total"), F.array_max(F.transform("s.q", F.abs)).alias("most"))


@query("s03_yaml", "SELECT 'r' || n_regionkey AS file, 'nation.n' || n_nationkey AS name, n_name AS value FROM nation UNION ALL SELECT 'r' || r_regionkey, 'key', r_regionkey::VARCHAR FROM region")
def s03_yaml(t: Tables) -> DataFrame:
    """Settings files in YAML by the path's extension."""
    path = f"{scratch(t.spark, 'yaml')}/settings.yaml"
    lines = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("  n"), F.col("n_nationkey").cast("string"), F.lit(": "), "n_name"))).alias("n"))
    text = F.concat_ws("\n", F.concat(F.lit("key: "), F.col("r_regionkey").cast("string")), F.lit("nation:"), F.array_join("n", "\n"))
    d = t.region.join(lines, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("file"), text.alias("text"))
    d.repartition("file").write.partitionBy("file").text(path)
    return R.load(t.spark, path).select(F.regexp_extract("path", "file=([^/]+)", 1).alias("file"), "name", "value")


@query(
    "m4_many_centres",
    _DOUBLES + ", u AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM e) SELECT q.vec_id, min_by(c.vec_id, {'s': -round(list_dot_product(q.u, c.u), 9), 'i': c.vec_id}) AS centre FROM u q, u c WHERE c.vec_id % 10 = 3 GROUP BY 1",
)
def m4_many(t: Tables) -> DataFrame:
    """The nearest of so many centres that they don't travel with the tasks, by blocks."""
    e = t.embeddings.select("vec_id", V.normalise("embedding").alias("u"))
    centres = e.where("vec_id % 10 = 3").select(F.col("vec_id").alias("l"), F.col("u").alias("c"))
    return M.nearest_label(e, "u", centres, "l", "c", "centre", most=1).select("vec_id", "centre")


#: Annotations of a document, about: a document is one cell and is read whole.
DOCUMENT = 25_000


@query(
    "s17_instance_sets",
    "SELECT o_orderkey::VARCHAR AS image_id, 'ADEChallengeData2016/images/validation/' || o_orderkey || '.jpg' AS image, id, (c % 7)::INT AS label, 'class ' || (c % 7) AS name, x, w, crowd FROM (SELECT l_orderkey AS o_orderkey, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, l_suppkey % 9 AS c, (l_partkey % 50)::DOUBLE AS x, l_quantity::DOUBLE AS w, l_linenumber = 3 AS crowd FROM lineitem) WHERE c < 7",
)
def s17_instances(t: Tables) -> DataFrame:
    """Instances of a named set by its own annotation file, classes numbered as it lists them; annotations of classes that it doesn't list go."""
    root, which = scratch(t.spark, "instances"), I.annotated_set("ade20k_instance_val")
    lines = t.lineitem
    one = F.struct(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("id"), F.col("l_orderkey").cast("string").alias("image_id"), (100 + F.col("l_suppkey") % 9).cast("int").alias("category_id"),
        F.array((F.col("l_partkey") % 50).cast("double"), F.lit(1.0), F.col("l_quantity").cast("double"), F.lit(2.0)).alias("bbox"), (F.col("l_linenumber") == 3).cast("int").alias("iscrowd"),
    )
    image = F.struct(F.col("l_orderkey").cast("string").alias("id"), F.concat(F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"))
    classes = F.array(*[F.struct(F.lit(100 + k).alias("id"), F.lit(f"class {k}").alias("name")) for k in range(7)])
    parts = -(-lines.count() // DOCUMENT) or 1
    whole = lines.groupBy((F.col("l_orderkey") % parts).alias("part")).agg(F.collect_set(image).alias("images"), F.collect_list(one).alias("annotations")).select("part", classes.alias("categories"), "images", "annotations")
    whole.write.partitionBy("part").json(f"{root}/{which.annotations}")  # documents of a bounded part each
    return I.instances(t.spark, root, which).select("image_id", "image", "id", "label", "name", "x", "w", "crowd")


@query(
    "t16_oversampled_points",
    "WITH p AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY " + _seeded_sql("event_id") + ", event_id) AS k FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY event_type, k <= 60 ORDER BY abs(value - 50), event_id) AS r FROM p) "
    "SELECT event_id, event_type FROM s WHERE (k <= 60 AND r <= 15) OR (k > 60 AND k <= 65)",
)
def t16_over(t: Tables) -> DataFrame:
    """Fifteen uncertain points of sixty drawn ones, and five more, for each type."""
    d = t.events.select("event_id", "event_type", (F.col("value") - 50).alias("logit"))
    return S.oversampled_points(d, ["event_type"], "logit", "event_id", 20).select("event_id", "event_type")


@query("t12_seeded_choices", "SELECT c_custkey, ['a', 'b', 'c', 'd', 'e'][least(4, floor(" + _uniform_sql("c_custkey", seed="12") + " * 5))::INT + 1] AS prompt FROM customer")
def t12(t: Tables) -> DataFrame:
    """A prompt for each row, drawn by seed."""
    return t.customer.select("c_custkey", S.seeded_choice(12, "c_custkey", list("abcde")).alias("prompt"))
