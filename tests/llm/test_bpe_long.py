"""Texts without blanks: memory, and results against the library."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from lumenforge.llm import bpe


@pytest.fixture(scope="module")
def files():
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = str(P.path("byte_bpe_50k.json"))
    with open(path, encoding="utf-8") as f:
        return path, bpe.Vocabulary(f.read()), tokenizers.Tokenizer.from_file(path)


def blank_free(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(["the", "a", "xq", "é", "12", "a", "字", "aaaa", "-", "."]) for _ in range(n // 2))


def test_long_words_equal_the_library(files):
    _, v, t = files
    e = bpe.Encoder(v, None)
    texts = [blank_free(1, 40_000), "a" * 30_000, "ab" * 9_000 + " " + "é" * 9_000, "".join(random.Random(2).choice("abcdefgh") for _ in range(20_000))]
    for text, ids in zip(texts, e.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert e.decode(ids) == text


def test_memory_on_texts_without_blanks(files):
    _, v, _ = files
    e = bpe.Encoder(v, None, cache=8 << 20)
    tracemalloc.start()
    for k in range(12):
        e.encode_batch([blank_free(k, 200_000), f"{k} short ones " * 2000])
        assert not any(len(p) > bpe.LONGEST_WORD for p in [*e.spaced, *e.plain])
        assert e.held >= sum(map(len, e.spaced)) + sum(map(len, e.spaced.values()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def test_long_pieces_are_not_counted(spark, files):
    path, _, t = files
    texts = [blank_free(k, 1_000_000) for k in range(6)] + ["x" * 256 + " " + "y" * 257 + " b b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {bytes(r["piece"]).decode(): r["n"] for r in bpe.piece_counts(d).collect()}
    assert got == {"x" * 256: 1, "b": 2}
    small = bpe.piece_counts(spark.createDataFrame([(" ".join(f"w{i}" for i in range(90_000)) + " a",), ("a a",)], "text string"), held=1 << 20)
    assert {(bytes(r["piece"]), r["n"]) for r in small.where("n > 1").collect()} == {(b"a", 3)} and small.count() == 90_001
    row = bpe.encode_documents(d.where("doc_id = 6"), path).first()
    assert row["n_tokens"] == len(t.encode(texts[6], add_special_tokens=False).ids)
