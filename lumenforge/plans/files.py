"""Registered queries of sources and sinks: tables go to files of the shared folder and come back through the engine's readers."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import scorers
from ..runtime import scratch, write_file
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import streams as Z
from . import config, registry
from .catalog import Tables, query, r6


@query("s01_annotations", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey <> 3")
def s01(t: Tables) -> DataFrame:
    """JSON of several files in one table, rows without a required field gone."""
    out = scratch(t.spark, "annotations")
    d = t.customer.select("c_custkey", "c_mktsegment", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("scene_id"))
    for k in range(2):
        d.where(F.col("c_custkey") % 2 == k).write.json(f"{out}/part{k}")
    return R.annotations(t.spark, [f"{out}/part0", f"{out}/part1"], "c_custkey long, c_mktsegment string, scene_id int", ["scene_id"], lines=True).select("c_custkey", "c_mktsegment")


@query("s03_load_by_extension", "SELECT f.f AS format, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(f)")
def s03(t: Tables) -> DataFrame:
    """A table written and read by the path's extension."""
    base, out = scratch(t.spark, "formats"), None
    for ext in ("csv", "json", "orc", "parquet"):
        path = f"{base}/nation.{ext}"
        K.save(t.nation, path)
        d = R.load(t.spark, path, multiLine=False) if ext == "json" else R.load(t.spark, path)
        d = d.select(F.lit(ext).alias("format"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
        out = d if out is None else out.unionByName(d)
    return out


@query("s05_s06_listing", "SELECT 'part=' || n_regionkey AS class_name, (row_number() OVER (ORDER BY n_regionkey) - 1)::INT AS label, count(*) OVER () AS files FROM (SELECT DISTINCT n_regionkey FROM nation)")
def s05(t: Tables) -> DataFrame:
    """Files by folder: the folder names the class."""
    out = scratch(t.spark, "folders")
    t.nation.select(F.col("n_regionkey").alias("part"), "n_name").coalesce(1).write.partitionBy("part").option("header", True).csv(out)
    n = R.listing(t.spark, out, "*.csv").count()
    return R.image_folder(t.spark, out, "*.csv").select("class_name", "label", F.lit(n).cast("long").alias("files"))


def _archives(t: Tables, base: str) -> None:
    """A small archive for each region: its nations' names as members."""
    for r in t.region.select("r_regionkey").collect():
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w") as tar:
            for n in t.nation.where(F.col("n_regionkey") == r["r_regionkey"]).select("n_nationkey", "n_name").collect():
                data = n["n_name"].encode()
                info = tarfile.TarInfo(f"r/{n['n_nationkey']:03}.txt")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        write_file(t.spark, f"{base}/{r['r_regionkey']}.tar", raw.getvalue())


@query("s07_archive_members", "SELECT lpad(n_nationkey::VARCHAR, 3, '0') AS key, 'txt' AS ext, n_name AS name FROM nation")
def s07(t: Tables) -> DataFrame:
    """Members of archives."""
    base = scratch(t.spark, "archives")
    _archives(t, base)
    return R.tar_members(t.spark, base).where("error is null").select("key", "ext", F.col("content").cast("string").alias("name"))


@query("s08_result_shards", "SELECT question_id, answer FROM (SELECT o_orderkey // 2 AS question_id, o_orderpriority AS answer, o_orderkey % 3 AS rank, o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank, o_orderkey) = 1")
def s08(t: Tables) -> DataFrame:
    """Result files of ranks, merged in the ranks' order, the first of each question."""
    base, out = scratch(t.spark, "ranks"), scratch(t.spark, "merged")
    d = t.orders.select(F.floor(F.col("o_orderkey") / 2).alias("question_id"), F.col("o_orderpriority").alias("answer"), "o_orderkey")
    for rank in range(3):
        d.where(F.col("o_orderkey") % 3 == rank).write.json(f"{base}/val_0_vqa_result_rank{rank}.json")
    shards = R.result_shards(t.spark, f"{base}/*", "question_id long, answer string, o_orderkey long", lines=True)
    K.save_result(shards, out, "question_id", ["rank", "o_orderkey"])
    return t.spark.read.schema("question_id long, answer string").json(out)


def _array_files(t: Tables) -> str:
    """A small array file for each region: nation keys times 0.5 in rows of two, as many as the region has nations."""
    base = scratch(t.spark, "arrays")
    for r in t.region.select("r_regionkey").collect():
        keys = sorted(x[0] for x in t.nation.where(F.col("n_regionkey") == r["r_regionkey"]).select("n_nationkey").collect())
        raw = io.BytesIO()
        np.save(raw, np.array([[k * 0.5, k * 0.25] for k in keys]))
        write_file(t.spark, f"{base}/{r['r_regionkey']}.npy", raw.getvalue())
    return base


@query("s09_point_arrays", "SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row, n_nationkey * 0.5::DOUBLE AS a, n_nationkey * 0.25::DOUBLE AS b FROM nation")
def s09(t: Tables) -> DataFrame:
    """Array files as points."""
    d = R.points(R.arrays(t.spark, _array_files(t)), 2)
    return d.select(F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("int").alias("n_regionkey"), "row", F.get("values", 0).alias("a"), F.get("values", 1).alias("b"))


@query("s10_depth_maps", "WITH n AS (SELECT n_regionkey, n_nationkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS y FROM nation) SELECT n_regionkey, y, x::INT AS x, n_nationkey * 0.5::DOUBLE / (x + 1) AS value FROM n, (SELECT unnest([0, 1]) AS x)")
def s10(t: Tables) -> DataFrame:
    """Array files as depth maps, a row for each pixel."""
    d = R.pixels(R.arrays(t.spark, _array_files(t)))
    return d.select(F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("int").alias("n_regionkey"), "y", F.col("x").cast("int").alias("x"), "value")


def _panoptic(t: Tables) -> DataFrame:
    """Annotations of an image for each order, its lines as segments."""
    s = F.struct(F.col("l_linenumber").cast("int").alias("id"), F.when(F.col("l_suppkey") % 9 == 0, 255).otherwise(F.col("l_suppkey") % 9).cast("int").alias("category_id"), (F.col("l_partkey") % 5 == 0).cast("int").alias("iscrowd"))
    images = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(s)).alias("segments_info"))
    one = F.struct(F.col("l_orderkey").cast("string").alias("image_id"), F.concat(F.lit("im."), F.col("l_orderkey").cast("string"), F.lit(".png")).alias("file_name"), "segments_info")
    return images.select(F.array(one).alias("annotations"))


@query("s15_panoptic", "SELECT l_orderkey::VARCHAR AS image_id, 'images/im.' || l_orderkey || '.jpg' AS image, 'masks/im.' || l_orderkey || '.png' AS mask, count(*)::INT AS n FROM lineitem GROUP BY 1, 2, 3")
def s15(t: Tables) -> DataFrame:
    """Annotated images with their paths."""
    return R.panoptic(_panoptic(t), "images", "masks").select("image_id", "image", "mask", F.size("segments_info").alias("n"))


@query("p18_segments", "SELECT l_orderkey::VARCHAR AS image_id, (l_suppkey % 9)::INT AS category_id, count(*) AS n FROM lineitem WHERE l_suppkey % 9 <> 0 AND l_partkey % 5 <> 0 GROUP BY 1, 2")
def p18(t: Tables) -> DataFrame:
    """Classes in an image, without crowds and what is to be ignored."""
    d = R.segments(R.panoptic(_panoptic(t), "images", "masks"))
    return d.groupBy("image_id", "category_id").agg(F.count("*").alias("n"))


@query("s18_registered_loader", "SELECT 'train' AS split, n_nationkey, upper(n_name) AS n_name FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'val', n_nationkey, n_name FROM nation WHERE n_regionkey >= 3")
def s18(t: Tables) -> DataFrame:
    """Splits by a registered loader and its transforms, and their names for SQL."""
    base = scratch(t.spark, "splits")
    t.nation.where("n_regionkey < 3").write.parquet(f"{base}/train")
    t.nation.where("n_regionkey >= 3").write.parquet(f"{base}/val")
    for kind, name, thing in (("loader", "nations", lambda spark, path: spark.read.parquet(path)), ("transform", "shout", lambda d: d.withColumn("n_name", F.upper("n_name")))):
        registry.registry.unregister(kind, name)
        registry.registry.register(kind, name)(thing)
    splits = registry.build_splits(t.spark, "nations", {"train": f"{base}/train", "val": f"{base}/val"}, {"train": ["shout"]})
    registry.register_views({f"nations_{k}": d for k, d in splits.items()})
    assert {"nations_train", "nations_val"} <= set(registry.table_names(t.spark))
    return t.spark.sql("SELECT 'train' AS split, n_nationkey, n_name FROM nations_train UNION ALL SELECT 'val', n_nationkey, n_name FROM nations_val")


@query("k05_metric_log", "SELECT k::INT AS epoch, l_returnflag, round(avg(l_quantity) + k, 6) AS value FROM lineitem, (SELECT unnest([0, 1]) AS k) GROUP BY k, l_returnflag")
def k05(t: Tables) -> DataFrame:
    """Metrics of two epochs added to one log."""
    path = scratch(t.spark, "log")
    for k in (0, 1):
        K.append_metrics(t.lineitem.groupBy("l_returnflag").agg(r6(F.avg("l_quantity") + k).alias("value")).withColumn("epoch", F.lit(k)), path)
    return t.spark.read.schema("epoch int, l_returnflag string, value double").json(path)


@query("k07_scene_files", "SELECT label::INT AS label, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1")
def k07(t: Tables) -> DataFrame:
    """Points in a folder for each scene."""
    path = scratch(t.spark, "scenes")
    K.save_points(t.embeddings.select("vec_id", "label"), path, "label")
    return t.spark.read.schema("vec_id long, label int").parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("k08_append_new", "SELECT n_nationkey, n_name FROM nation")
def k08(t: Tables) -> DataFrame:
    """Two appends of overlapping rows leave each once."""
    path = scratch(t.spark, "appended")
    K.append_new(t.nation.where("n_nationkey < 15").select("n_nationkey", "n_name"), path, "n_nationkey")
    K.append_new(t.nation.where("n_nationkey > 5").select("n_nationkey", "n_name"), path, "n_nationkey")
    return t.spark.read.schema("n_nationkey int, n_name string").parquet(path)


@query("u02_mixed_streams", "SELECT key, name FROM (SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier)")
def u02(t: Tables) -> DataFrame:
    """Two streams by their shared columns, run to their end."""
    base = scratch(t.spark, "streams")
    t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_acctbal").write.parquet(f"{base}/a")
    t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), "s_nationkey").write.parquet(f"{base}/b")
    sources = [Z.file_stream(t.spark, f"{base}/{x}", t.spark.read.parquet(f"{base}/{x}").schema, files_per_trigger=2) for x in "ab"]
    out = scratch(t.spark, "mixed")
    # a batch that is run again writes its own folder again
    Z.drain(Z.mixed_stream(sources), lambda rows, k: rows.write.mode("overwrite").parquet(f"{out}/batch={k}"), scratch(t.spark, "checkpoint"))
    return t.spark.read.parquet(out).select("key", "name")


@query("a02_first_seen_stream", "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def first_seen(t: Tables) -> DataFrame:
    """The first row of each user and type on a stream."""
    files = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    out = scratch(t.spark, "first")
    Z.drain(Z.first_seen(files, ["user_id", "event_type"], delay="60 days").select("user_id", "event_type"), lambda rows, k: rows.write.mode("overwrite").parquet(f"{out}/batch={k}"), scratch(t.spark, "checkpoint"))
    return t.spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"))


@query("u04_u06_key_checks", "SELECT 'same' AS what, count(*) AS n FROM nation UNION ALL SELECT 'missing', 1")
def u04(t: Tables) -> DataFrame:
    """Equal key sets pass, a ratio without a source is told."""
    D.require_same_keys(t.nation, t.nation.repartition(3), "n_nationkey")
    try:
        D.check_ratios(["a", "b"], {"a": 1.0})
        missing = 0
    except ValueError:
        missing = 1
    return t.nation.agg(F.lit("same").alias("what"), F.count("*").alias("n")).unionByName(t.spark.createDataFrame([("missing", missing)], "what string, n long"))


@query("f28_p20_settings", "SELECT * FROM (VALUES ('lr', '0.1'), ('run.task', 'vqa'), ('run.world', '8'), ('steps', '5')) v(name, value)")
def f28(t: Tables) -> DataFrame:
    """Settings merged, overridden by dotted names and checked."""
    c = config.merge({"lr": 0.5, "run": {"task": "vqa", "world": 1}}, {"lr": 0.1}, config.dotted(["run.world=8", "steps=5"]))
    c = config.check(c, {"lr": {"type": float}, "steps": {"type": int, "choices": [5, 10]}, "run": {"type": dict, "required": True}})
    rows = [("lr", c["lr"]), ("steps", c["steps"]), *[(f"run.{k}", v) for k, v in c["run"].items()]]
    return t.spark.createDataFrame([(k, str(v)) for k, v in rows], "name string, value string")


@query("d10_scorer_retry", "SELECT c_custkey, length(c_name)::BIGINT AS score FROM customer")
def d10(t: Tables) -> DataFrame:
    """A model call that fails at first in every task and is tried again."""

    def make():
        calls = [0]

        def scorer(b):
            calls[0] += 1
            if calls[0] == 1:
                raise RuntimeError("not yet")
            return b.assign(score=b["c_name"].str.len())[["c_custkey", "score"]]

        return scorer

    return scorers.score(t.customer.select("c_custkey", "c_name"), make, "c_custkey long, score long", batch_rows=500, attempts=3, wait=0.01)


@query("t14_turns", "SELECT doc_id, lang AS source, round(row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) / CASE lang WHEN 'en' THEN 2.0 ELSE 1.0 END, 6) AS turn FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')")
def t14_turns(t: Tables) -> DataFrame:
    """All documents of all languages with the turn at which a mixing loader deals them."""
    from ..operators import sampling as S

    d = S.mixture_stream([(x, t.documents.where(F.col("lang") == x), 2.0 if x == "en" else 1.0) for x in ("en", "fr", "de", "es")], "doc_id")
    return d.withColumn("turn", r6(F.col("turn")))


@query("s13_zip_members", "SELECT lpad(n_nationkey::VARCHAR, 3, '0') AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'gz' ELSE 'zip' END AS kind, n_name AS name FROM nation")
def s13(t: Tables) -> DataFrame:
    """Members of zip archives and of gz files."""
    base = scratch(t.spark, "zips")
    names = {r["n_nationkey"]: r["n_name"] for r in t.nation.select("n_nationkey", "n_name").collect()}
    for k in range(1, 5):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for n, name in names.items():
                if n % 5 == k:
                    z.writestr(f"r/{n:03}.txt", name)
        write_file(t.spark, f"{base}/{k}.zip", raw.getvalue())
    for n, name in names.items():
        if n % 5 == 0:
            write_file(t.spark, f"{base}/{n:03}.txt.gz", gzip.compress(name.encode()))
    d = R.zip_members(t.spark, base, "*.zip").withColumn("kind", F.lit("zip")).unionByName(R.zip_members(t.spark, base, "*.gz").withColumn("kind", F.lit("gz")))
    return d.where("error is null").select("key", "kind", F.col("content").cast("string").alias("name"))


@query("s11_decoded_frames", "SELECT n_nationkey, i::INT AS frame, ascii(n_name[(i * length(n_name)) // 4 + 1])::INT AS value FROM nation, (SELECT unnest(range(0, 4)) AS i)")
def s11_frames(t: Tables) -> DataFrame:
    """Four frames of each video by an injected decoder; here a name's letters are the frames."""
    from ..operators import sampling as S

    d = t.nation.select("n_nationkey", F.encode("n_name", "utf-8").alias("content"), S.frame_indices(4, F.length("n_name")).alias("wanted"))

    def make():
        import pandas as pd

        return lambda b: pd.DataFrame([(k, i, c[at]) for k, c, w in zip(b["n_nationkey"], b["content"], b["wanted"], strict=True) for i, at in enumerate(w)], columns=["n_nationkey", "frame", "value"])

    return R.frames(d, make, "n_nationkey int, frame int, value int")


@query("k11_resumed_stream", "SELECT n_nationkey, (n_nationkey >= 10)::INT AS run FROM nation")
def k11(t: Tables) -> DataFrame:
    """A stream that stops and goes on from its checkpoint: the second run takes only files that came since."""
    source, out, mark = scratch(t.spark, "source"), scratch(t.spark, "runs"), scratch(t.spark, "checkpoint")
    for run, part in enumerate(("n_nationkey < 10", "n_nationkey >= 10")):
        t.nation.where(part).select("n_nationkey").write.mode("append").parquet(source)
        stream = Z.file_stream(t.spark, source, t.nation.select("n_nationkey").schema)
        Z.drain(stream, lambda rows, k, run=run: rows.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{out}/batch={k}"), mark)
    return t.spark.read.parquet(out).select("n_nationkey", "run")


@query("s17_image_sets", "SELECT 'mapillary_vistas_sem_seg_train' AS name, 'n/' || n_nationkey AS stem, 65 AS ignore FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'ade20k_full_sem_seg_val', 'n/' || n_nationkey, 65535 FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0")
def s17(t: Tables) -> DataFrame:
    """Images and label files of two named sets; images without a label file go."""
    from ..sources import image_sets as I

    root, out = scratch(t.spark, "sets"), None
    for name, region in (("mapillary_vistas_sem_seg_train", 1), ("ade20k_full_sem_seg_val", 2)):
        s = I.image_set(name)
        for (k,) in t.nation.where(F.col("n_regionkey") == region).select("n_nationkey").collect():
            write_file(t.spark, f"{root}/{s.images}/n/{k}.{s.image_ext}", b"image")
            if region == 1 or k % 2 == 0:
                write_file(t.spark, f"{root}/{s.labels}/n/{k}.{s.label_ext}", b"label")
        d = I.pairs(t.spark, root, s).select(F.lit(name).alias("name"), "stem", "ignore")
        out = d if out is None else out.unionByName(d)
    return out


@query("s16_panoptic_sets", "SELECT l_orderkey::VARCHAR AS image_id, 'sem/im.' || l_orderkey || '.png' AS semantic, l_linenumber::INT AS id, CASE WHEN l_suppkey % 9 IN (1, 2, 3) THEN l_suppkey % 9 - 1 ELSE 10 + l_suppkey % 9 END::INT AS category_id, l_suppkey % 9 IN (1, 2, 3) AS isthing FROM lineitem WHERE l_suppkey % 9 <> 0")
def s16(t: Tables) -> DataFrame:
    """Segments with contiguous categories, things and stuff by two maps."""
    from ..sources import image_sets as I

    things = t.spark.createDataFrame([(k, k - 1) for k in (1, 2, 3)], "key int, id int")
    stuff = t.spark.createDataFrame([(k, k + 10) for k in (4, 5, 6, 7, 8)], "key int, id int")
    d = I.panoptic_rows(_panoptic(t), "images", "masks", "sem", things, stuff)
    return d.where("category_id is not null").select("image_id", "semantic", "id", "category_id", "isthing")


def _exr(rows: list[list[float]], packed: bool) -> bytes:
    """A small file with one channel Z of floats, deflated or as it is."""
    a = np.array(rows, dtype="<f4")
    h, w = a.shape
    lines = 16 if packed else 1
    head = struct.pack("<II", 20000630, 2)
    for name, kind, value in (("channels", "chlist", b"Z\0" + struct.pack("<iiii", 2, 0, 1, 1) + b"\0"), ("compression", "compression", bytes([3 if packed else 0])), ("dataWindow", "box2i", struct.pack("<4i", 0, 0, w - 1, h - 1))):
        head += name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value
    head += b"\0"
    blocks = []
    for y in range(0, h, lines):
        raw = a[y : y + lines].tobytes()
        d = np.concatenate([np.frombuffer(raw, np.uint8)[0::2], np.frombuffer(raw, np.uint8)[1::2]]).astype(np.int64)
        data = zlib.compress(np.concatenate([d[:1], (d[1:] - d[:-1] + 128) & 255]).astype(np.uint8).tobytes()) if packed else raw
        data = raw if len(data) >= len(raw) else data
        blocks.append(struct.pack("<ii", y, len(data)) + data)
    at, offsets = len(head) + 8 * len(blocks), []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    return head + struct.pack(f"<{len(blocks)}Q", *offsets) + b"".join(blocks)


@query("s10_exr_depth", "SELECT r_regionkey, y::INT AS y, x::INT AS x, (r_regionkey * 100 + y * 0.5 + x * 0.25)::DOUBLE AS value FROM region, (SELECT unnest(range(0, 20)) AS y), (SELECT unnest(range(0, 12)) AS x)")
def s10_exr(t: Tables) -> DataFrame:
    """OpenEXR files as depth maps, a row for each pixel."""
    from ..sources import exr

    base = scratch(t.spark, "exr")
    for (k,) in t.region.select("r_regionkey").collect():
        write_file(t.spark, f"{base}/{k}.exr", _exr([[k * 100 + y * 0.5 + x * 0.25 for x in range(12)] for y in range(20)], k % 2 == 0))
    d = R.pixels(exr.depth_maps(t.spark, base, "Z"))
    return d.select(F.regexp_extract("path", r"(\d+)\.exr$", 1).cast("int").alias("r_regionkey"), "y", F.col("x").cast("int").alias("x"), "value")
