"""Mixing, quality, licences and sharding against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenforge.llm import licenses, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, row string, target double"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(["the", "of", "cat", "dog", "runs", "and", "sleeps", "quietly", "house", "é"]) + str(r.randint(0, 400)) * (r.random() < 0.6) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    rows = [(i, prose(r, r.randint(1, 120)), "en", r.choice(["b", "a", None, "ä", "c"]), 0, 1, "x", 0.5) for i in range(120)]
    rows += [(500, None, None, "a", None, None, None, None), (501, "", "en", "b", 0, 0, "", 0.0), (502, " \n\t ", "en", "zero", 0, 0, "", 0.0), (None, prose(r, 30), "en", "a", 0, 0, "", 0.0)]
    rows += [rows[3], rows[3], (503, rows[4][1], "en", "c", 0, 0, "", 0.0), (504, "long " * 30000, "en", "b", 0, 0, "", 0.0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_mixing(spark, docs):
    got = mixing.mix_sources(frame(spark, docs)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d[0], size(d[1])) for d in docs)
    total = defaultdict(int)
    for d in docs:
        total[d[3]] += size(d[1])
    names = sorted((k for k in total if k is not None), key=lambda x: x.encode()) + [None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    cap, budget, stopped = {n: 2.0 * total[n] for n in names}, 1.5 * sum(total.values()), set()
    while True:
        level = (budget - sum(cap[n] for n in stopped)) / sum(weight[n] for n in names if n not in stopped)
        over = {n for n in names if n not in stopped and level * weight[n] > cap[n]}
        if not over:
            break
        stopped |= over
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(cap[r["source"]] if r["source"] in stopped else level * weight[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    for n in names:
        want = cap[n] if n in stopped else level * weight[n]
        assert abs(taken[n] - want) <= most[n] / 2 + 1
    again = mixing.mix_sources(frame(spark, docs).repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    rows = mixing.mix_documents(frame(spark, docs))
    assert rows.columns == frame(spark, docs).columns
    unique = {d[0] for d in docs if sum(x[0] == d[0] for x in docs) == 1}
    n = Counter(r["doc_id"] for r in rows.collect())
    assert all(n[r["doc_id"]] == r["copies"] for r in got if r["doc_id"] in unique)
    assert mixing.mix_sources(frame(spark, docs).where("false")).count() == 0


def statistics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, docs):
    r = random.Random(1)
    more = [(600 + i, "\n".join(["same line here again and again now"] * r.randint(1, 6)) + "\n" + prose(r, 40), "en", "a", 0, 0, "", 0.0) for i in range(10)]
    more += [(700 + i, " ".join(w + r.choice(["###", "%%%", "$$$"]) for w in prose(r, 80).split()), "en", "a", 0, 0, "", 0.0) for i in range(20)]
    rows = docs + more
    d = frame(spark, rows)
    got = quality.judge(d).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((x["doc_id"], *[x[n] for n in names]) for x in got) == Counter((x[0], *statistics(x[1])) for x in rows)
    for x in got:
        assert x["base_failed"] == (x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"])
        assert not (x["base_failed"] and x["kept"])
    assert not any(x["kept"] for x in got if (x["doc_id"] or 0) >= 700)
    kept = quality.keep_good(d)
    assert kept.columns == d.columns
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(x["doc_id"] for x in got if x["kept"])
    assert quality.judge(d.where("false")).count() == 0 and quality.keep_good(d.where("false")).count() == 0


def test_vote_model_learns_accuracies():
    good, bad = (1, 0, 1), (-1, -1, 1)
    odds, ratio = quality.fit_votes([(bad, 10), (good, 90)])
    assert ratio[1][0] < 0 and ratio[0][0] < 0 < ratio[0][2] and odds > 0
    assert quality.fit_votes([])[1] == []


def test_licenses(spark):
    texts = [
        "Released under the MIT License.", "mit-LICENSE and MIT  license; the mit\nlicense", "Licensed under the Apache License, Version 2.0.", "GNU General Public License", "Licensed under CC BY-NC 4.0.",
        "submit license", "mit licensee", "", None, "word " * 20000 + "MIT License", "émit license", "This is free and unencumbered software released into the public domain.", "Permission is hereby granted, free of charge, to any person",
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, w string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(d).collect()}
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        at = [(j, v) for p, v in phrases.items() for j in range(len(words)) if tuple(words[j : j + len(p)]) == p]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(at), ",".join(sorted({v for _, v in at}))), t
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert got[2]["labels"] == "apache,apache-2.0" and got[4]["labels"] == "cc-by-nc" and got[11]["labels"] == "unlicense" and "mit" in got[12]["labels"]
    assert got[0]["score"] == pytest.approx(1) and got[5]["labels"] == ""
    assert licenses.scan_licenses(d.where("false")).count() == 0


def best_capacity(sizes, n):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, at = (lo + hi) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        lo, hi = (lo, mid) if used <= n else (mid + 1, hi)
    return lo


def test_sharding(spark, docs):
    d = frame(spark, docs)
    got = sharding.shard_documents(d, n_shards=8)
    text = {r: t for r, t in ((x[0], x[1]) for x in docs)}
    rows = got.collect()
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"bytes"}
    for r in rows:
        t = text[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(8)) and all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    where = defaultdict(set)
    for r in rows:
        where[text[r["doc_id"]] or ""].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())
    groups = d.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("b")).groupBy("h").agg(F.sum("b").alias("bytes"))
    ordered = [r["bytes"] for r in groups.orderBy("h").collect()]
    cap, begins = sharding.minimax_cuts(groups, 8)
    assert cap == best_capacity(ordered, 8)
    assert max(sum(r["size"] for r in x) for x in by.values()) <= cap
    rest = [sum(r["size"] for r in x) for x in by.values() if not any(r["doc_id"] == 504 for r in x)]
    assert max(rest) - min(rest) <= 3 * max(b for b in ordered if b < 100_000) + sum(b for b in ordered if b < 100_000) / 6
    assert sharding.shard_documents(d.where("false")).count() == 0
