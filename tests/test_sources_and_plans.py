"""Readers, sinks, streams, registry and settings."""

from __future__ import annotations

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge import schemas
from lumenforge.plans import config
from lumenforge.plans.registry import Registry
from lumenforge.sources import readers as R
from lumenforge.sources import sinks as K
from lumenforge.streaming import streams


def test_annotations_and_shards(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"scene_id": "s1", "question": "q", "answers": ["x"]}, {"question": "lost", "answers": []}]))
    d = R.annotations(spark, [str(tmp_path / "a.json")], schemas.QA, required=["scene_id"])
    assert [r["scene_id"] for r in d.collect()] == ["s1"]
    for rank in (0, 2, 10):
        (tmp_path / f"r_rank{rank}.json").write_text(json.dumps([{"question_id": 1, "answer": f"from {rank}"}]))
    shards = R.result_shards(spark, str(tmp_path / "r_rank*.json"), schemas.PREDICTIONS)
    assert sorted(r["rank"] for r in shards.collect()) == [0, 2, 10]
    out = str(tmp_path / "out")
    K.save_result(shards, out, key="question_id")
    assert [r["answer"] for r in spark.read.json(out).collect()] == ["from 0"]


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n')
    good, bad = R.quarantine(spark, [str(tmp_path / "x.jsonl")], T.StructType([T.StructField("a", T.IntegerType())]))
    assert [r["a"] for r in good.collect()] == [1] and [r["value"] for r in bad.collect()] == ["{broken"]


def test_binary_formats(spark, tmp_path):
    np.save(tmp_path / "p.npy", np.arange(6.0).reshape(2, 3))
    d = R.arrays(spark, str(tmp_path))
    assert sorted(r["values"] for r in R.points(d, 3).collect()) == [[0, 1, 2], [3, 4, 5]]
    assert {(r["y"], r["x"]): r["value"] for r in R.pixels(d).collect()}[(1, 2)] == 5.0
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        info = tarfile.TarInfo("k/1.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    (tmp_path / "bad.tar").write_bytes(b"nothing")
    rows = R.tar_members(spark, str(tmp_path)).collect()
    assert {(r["key"], r["ext"]) for r in rows if r["error"] is None} == {("1", "txt")} and sum(r["error"] is not None for r in rows) == 1


def test_image_folder_and_load(spark, tmp_path):
    for c in ("dog", "cat"):
        (tmp_path / "img" / c).mkdir(parents=True)
        (tmp_path / "img" / c / "1.png").write_bytes(b"x")
    assert {(r["class_name"], r["label"]) for r in R.image_folder(spark, str(tmp_path / "img")).collect()} == {("cat", 0), ("dog", 1)}
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    assert R.load(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        R.load(spark, "x.pkl")
    assert R.simple_yaml("a:\n  b: 1\n  c: [1, 2]\nd: text # note\n") == {"a": {"b": 1, "c": [1, 2]}, "d": "text"}


def test_append_new_adds_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "done")
    K.append_new(spark.range(3), path, "id")
    K.append_new(spark.range(5), path, "id")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_stream_equals_batch(spark, tmp_path):
    d = spark.range(200).select("id", F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).cast("string").alias("k"), F.lit(1.0).alias("value"))
    d.write.parquet(str(tmp_path / "in"))
    got: list = []
    streams.drain(streams.windowed_counts(streams.file_stream(spark, str(tmp_path / "in"), d.schema), ["k"]), lambda b, _: got.extend(b.collect()), str(tmp_path / "cp"), "complete")
    want = d.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")), "k").count().collect()
    assert sorted((r["start"], r["k"], r["n"]) for r in got) == sorted(map(tuple, want))


def test_registry_and_settings():
    r = Registry()
    r.register("task", "a")(1)
    with pytest.raises(KeyError):
        r.register("task", "a")(2)
    assert r.get("task", "a") == 1 and r.unregister("task", "a") == 1 and r.names("task") == []
    assert config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert config.dotted(["a.b=1", "c=true", "d=x"]) == {"a": {"b": 1}, "c": True, "d": "x"}
    with pytest.raises(ValueError):
        config.check({"z": 1}, {"a": {}})
    assert config.check({"a": "1"}, {"a": {"type": int, "choices": [1]}, "b": {"default": 2}}) == {"a": 1, "b": 2}


def test_panoptic_and_vqa_tables(spark):
    d = spark.createDataFrame([([("1", "a.b.png", [(1, 7, 0), (2, 8, 1), (3, 255, 0)])],)], schemas.PANOPTIC)
    assert R.panoptic(d, "im", "mk").first()["image"] == "im/a.b.jpg"
    assert [r["category_id"] for r in R.segments(R.panoptic(d, "im", "mk")).collect()] == [7]
