"""The positional index against a plain restatement over all templates and places, and what it must reject."""

from __future__ import annotations

import random
import re

import pytest

from lumenforge.llm import licenses as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return re.findall(L.WORD, (text or "").translate(LOWER))


def plain(text):
    """(labels, places, score) by trying every template at every place."""
    words = cut(text)
    idf, known = L.index()
    base = {v: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, v in L.BASE}
    labels, places, score = {v for v, at in base.items() if at}, set(), 0.0
    at = lambda i: words[i] if 0 <= i < len(words) else None
    for t in known:
        for o in range(-len(t["words"]), len(words)):
            key = any(at(o + i) == w for w, i, side in t["postings"] if side == 0)
            around = sum(at(o + i) == w for w, i, side in t["postings"] if side == 1)
            if not key or around < t["need"]:
                continue
            stands = lambda i, k: i >= 0 and words[i : i + len(k)] == k
            first, *more = zip(t["places"], t["keys"], strict=True)
            if stands(o + first[0], first[1]) and all(any(stands(o + i + d, k) for d in range(-L.SLACK, L.SLACK + 1)) for i, k in more):
                labels.add(t["label"])
                places.add(f"{t['label']}:{o + first[0]}")
                whole = sum(idf[w] for w in t["words"])
                score = max(score, sum(idf[w] for j, w in enumerate(t["words"]) if at(o + j) == w) / whole)
    for p, v in L.BASE:
        if base[v]:
            score = max(score, max(sum(idf[w] for w in p.split()) / sum(idf[w] for w in t["words"]) for t in known if t["label"] == v))
    return ",".join(sorted(labels)), places, min(1.0, score)


def test_index_equals_plain_search(spark):
    r = random.Random(6)
    texts = [None, "", "license " * 400, *(t[1] for t in L.TEMPLATES)]
    for _ in range(250):
        parts = []
        for _ in range(r.randint(1, 3)):
            words = r.choice(L.TEMPLATES)[1].split()
            a = r.randrange(len(words)) if r.random() < 0.4 else 0
            part = words[a : a + r.choice([3, 8, 20, 500])]
            if r.random() < 0.5:
                part.insert(r.randrange(len(part) + 1), r.choice(["the", "foo bar", "license", "- 2020 Ann -"]))
            if r.random() < 0.3 and len(part) > 2:
                del part[r.randrange(len(part))]
            parts.append(" ".join(part))
        texts.append(r.choice(["x ", "", "some words before. "]) + r.choice(["\n", " // "]).join(parts))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in L.scan_licenses(d).collect():
        labels, places, score = plain(texts[row["doc_id"]])
        assert row["labels"] == labels and set(filter(None, row["places"].split(","))) == places, texts[row["doc_id"]]
        assert row["score"] == pytest.approx(score)


def test_whole_texts_are_found(spark):
    mit = next(t for t in L.TEXTS if t[0] == "mit")[1]
    texts = ["/*\n * Copyright (c) 2020, Ann Other\n *\n * " + "\n * ".join(t[1].split("\n")) + "\n */\nint main() {}" for t in L.TEXTS] + [mit.replace("The above", "2. The (c) 2019 Ann above")]
    got = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(L.TEXTS):
        assert t[0] in got[k]["labels"].split(",") and got[k]["score"] > 0.95, t[0]
    assert "bsd-3-clause" not in got[[t[0] for t in L.TEXTS].index("bsd-2-clause")]["labels"].split(",")


def test_a_key_phrase_without_its_surroundings_is_rejected(spark):
    """The positions of the words around say no where the phrase alone would say yes."""
    texts = [
        "In their essay they let students use the tools to deal in the software without restriction and quote them freely.",
        "He said: anyone is free to copy modify publish use compile sell or distribute this software, as it were.",
        "A talk on the gnu general public license was cancelled.",
        "To deal, in the Software without restriction: the above copyright notice and this permission notice shall be included",
    ]
    got = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in range(4)] == ["", "", "gpl", ""]
    assert [got[k]["places"] for k in range(4)] == [""] * 4


def test_tags_parts_and_phrases_that_are_merely_named(spark):
    want = {
        "// SPDX-License-Identifier: MIT": "mit",
        "# SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0 OR GPL-3.0": "cc-by-sa",
        "The identifier mit stands in the table.": "",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "the EUPL (c) the European Union 2007. This European Union Public Licence (the 'EUPL') applies to the Work (as defined below)": "eupl",
        "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS": "epl",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce": "apache",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation": "bsd",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the": "gpl",
        "We visited the European Union public licence office.": "",
    }
    d = spark.createDataFrame([(k, t) for k, t in enumerate(want)] + [(None, "MIT"), (None, "MIT"), (0, None)], "doc_id long, text string")
    rows = L.scan_licenses(d).collect()
    assert len(rows) == len(want) + 3
    got = {r["doc_id"]: r for r in rows if r["n_words"]}
    for k, (text, labels) in enumerate(want.items()):
        assert set(filter(None, labels.split(","))) <= set(got[k]["labels"].split(",")) and (labels or got[k]["labels"] == ""), (text, got[k]["labels"])
    quoted = L.scan_licenses(spark.createDataFrame([(1, "We reject the MIT license for this project.")], "doc_id long, text string")).first()
    assert quoted["places"] == "" and quoted["labels"] == "mit"  # the contract's phrase stays, the index rejects the place
