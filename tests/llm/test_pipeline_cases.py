"""The pipeline over tables with null and repeated ids, equal rows, clashing columns, and none at all."""

from __future__ import annotations

import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, _gone int, node map<string,int>, w array<string>, t string, copies int"


def prose(r, n=70):
    return "The " + " ".join(r.choice(["the", "of", "and", "in", "cat", "house"]) + (str(r.randint(0, 999)) if r.random() < 0.5 else "") for _ in range(n)) + "."


def test_odd_rows(spark, tmp_path):
    r = random.Random(12)
    texts = [prose(r) for _ in range(30)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts[:20])]
    rows += [(None, t, "en", None, len(t)) for t in texts[20:]] + [(None, texts[25], "en", None, 0)] * 3  # no ids, copies among them
    rows += [(3, texts[3], "en", "b", len(texts[3]))] * 2 + [(4, prose(r), "en", "a", 0)]  # the same row again, one id for two texts
    rows += [(500, None, "en", "a", None), (None, None, None, None, None), (501, "", "", "", 0), (502, " \n", "en", "a", 2), (503, "word " * 60_000, "en", "a", 0)]
    rows += [(504, prose(r) + " password: Zq8rT2vL9pXw", "en", "a", 0)]
    full = [(*x, "r", 1, 2, {"a": 3}, ["x"], "t", 4) for x in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs = docs.cache()
        seen[name] = docs.collect()
    kept = Counter(x["text"] for x in seen["near dedup"])
    assert max(kept.values()) == 1 and set(kept) <= {x["text"] for x in seen["quality rules"]}
    assert {t for t in texts if t in {x["text"] for x in seen["quality rules"]}} <= set(kept)  # a text whose id another text shares isn't lost
    assert all(x["row"] == "r" and x["node"] == {"a": 3} and x["w"] == ["x"] for x in seen["source mix"])
    assert not any("Zq8rT2vL9pXw" in x["text"] for x in seen["secret scan"])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(x["doc_id"] for x in seen["source mix"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
