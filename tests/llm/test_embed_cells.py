"""Cells of large labels and long vectors: pivots that grow with a label, blocks bounded by bytes, honest counts."""

from __future__ import annotations

import numpy as np
import pytest

from lumenforge.llm import covertree, embed_dedup


def brute(x, labels, threshold=0.98):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    while True:
        new = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(x))])
        if (new == comp).all():
            return near.sum(axis=1).tolist(), comp.tolist()
        comp = new


@pytest.mark.parametrize(("n", "dim", "labels", "block", "pivots", "nbytes"), [(600, 8, 1, 8, 4, 1 << 24), (600, 8, 2, 300, 256, 1 << 24), (700, 1024, 2, 4096, 2, 1 << 10)])
def test_links_beyond_the_first_pivots(spark, monkeypatch, n, dim, labels, block, pivots, nbytes):
    monkeypatch.setattr(embed_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(embed_dedup, "BYTES", nbytes)
    rng = np.random.default_rng(n + dim)
    centres = rng.standard_normal((n // 6, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.14 * rng.standard_normal((n, dim))
    lab = rng.integers(0, labels, n)
    d = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, lab, strict=True))], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embed_dedup.near_embeddings(d, block=block, largest=block).collect())
    links, comp = brute(x, lab)
    assert sum(links) > n // 2
    assert got == [(i, links[i], comp[i], comp[i] == i) for i in range(n)]


def test_pivots_grow_with_the_largest_label(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PIVOTS", 4)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8))
    rows = [(i, "a", 8, 400, v.tobytes()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    reps = spark.createDataFrame(rows, "rep long, label string, dim int, n long, vec binary")
    assert len(embed_dedup._pivots(reps, 10, 10)[8]) == 40 and len(embed_dedup._pivots(reps, 400, 400)[8]) == 4
    assert int(embed_dedup._block_size(10**9, 64, 4096, 32768)) == 32768 and int(embed_dedup._block_size(10**9, 4096, 4096, 32768)) == 512


def test_pairs_of_single_vectors_count_as_compared():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen: dict = {}
    covertree.pairs_within(covertree.Tree(x), None, 0.98, lambda i, j: None, seen=seen)
    assert seen["pruned"] + seen["joined"] + seen["compared"] == 200 * 199 // 2 and seen["compared"] > 15_000
