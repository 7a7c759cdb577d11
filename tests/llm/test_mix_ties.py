"""Mixes of rows that share ids, have none or are the same in every column."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from lumenforge.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, m int, more long, _n int, row string, part map<string,int>, d string, h long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, n, 1, 2, 3, "r", {"a": n}, "d", 4) for i, t, s, n in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    text = lambda n: " ".join(r.choice("ab") for _ in range(n))
    out = [(None, text(r.randint(1, 30)), "a", 0) for _ in range(60)]  # no ids, other texts
    out += [(7, text(10), "b", k) for k in range(40)]  # one id, other texts or other columns
    out += [(8, "x y z", "c", 0)] * 45 + [(9, "p q", "c", 0)] * 20  # the same rows
    out += [(None, "only one two", None, 0)] * 25 + [(10, "w " * 500, "d", 0)] * 3
    out += [(20 + k, text(5), "a", 0) for k in range(30)] + [(11, None, "c", 0), (12, "", "e", 0), (12, "", "e", 0)]
    return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("chunk", [10_000, 4])
def test_targets_are_met_without_ids(spark, rows, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    d = frame(spark, rows)
    plan = mixing.mix_sources(d).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in plan) == Counter((i, words(t), s) for i, t, s, _ in rows)
    target, most = {r["source"]: r["target"] for r in plan}, defaultdict(int)
    for _, t, s, _ in rows:
        most[s] = max(most[s], words(t))
    out = mixing.mix_documents(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    got = out.collect()
    had = Counter((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in d.collect())
    made = Counter((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in got)
    assert set(made) <= set(had) and all(n <= 2 * had[k] for k, n in made.items())
    by_plan, by_rows = defaultdict(int), defaultdict(int)
    for r in plan:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        by_plan[r["source"]] += r["taken"]
    for r in got:
        by_rows[r["source"]] += words(r["text"])
    for s, want in target.items():
        assert abs(by_plan[s] - want) <= most[s] / 2 and abs(by_rows[s] - want) <= most[s] / 2, s
    again = mixing.mix_documents(d.repartition(7)).collect()
    assert Counter((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in again) == made


def test_no_row_is_taken_above_a_broken_number_of_epochs(spark, rows):
    for r in mixing.mix_sources(frame(spark, rows), budget=5.0, max_epochs=2.5).collect():
        assert r["copies"] <= 2.5


def test_empty(spark, rows):
    d = frame(spark, rows).where("false")
    assert mixing.mix_documents(d).count() == 0 and mixing.mix_documents(d).columns == d.columns and mixing.mix_sources(d).count() == 0
