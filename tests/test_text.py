"""Text rules against plain restatements, on the cases that decide them and on seeded strings."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lumenforge.functions import text as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values) or ["x"]).select(column.alias("o")).first()["o"] if values else spark.range(1).select(column.alias("o")).first()["o"]


def punctuation(t: str) -> str:
    out = t
    for p in X.PUNCTUATION:
        gone = p + " " in t or " " + p in t or re.search(r"\d,\d", t)
        out = out.replace(p, "" if gone else " ")
    return re.compile(r"\.(?!\d)").sub("", out, count=32)


def words(t: str) -> str:
    ws = [X.NUMBER_WORDS.get(w, w) for w in t.lower().split()]
    return " ".join(X.CONTRACTIONS.get(w, w) for w in ws if w not in X.ARTICLES)


def strings(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    bits = ["a", "an", "The", "one", "two", "ten", "dont", "isnt", "1,000", "3.5", "x.", ".", ",", "?", "/", "-", "(", ")", " ", "  ", "no", "yes", "\t", "’", "é", "Im", "\u00a0"]
    return ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_decided_cases(spark):
    assert one(spark, X.answer_punctuation("x"), x="a/b, c? 1,000 (x)") == "ab c 1000 x"
    assert one(spark, X.answer_punctuation("x"), x="no/yes") == "no yes"
    assert one(spark, X.answer_punctuation("x"), x="3.5 m. tall") == "3.5 m tall"
    assert one(spark, X.answer_punctuation("x"), x="a." * 33) == "a" * 32 + "a."
    assert one(spark, X.answer_words("x"), x="one a two cat") == "1 2 cat"
    assert (one(spark, X.clean_caption("x"), x="A.B"), one(spark, X.clean_question("x"), x="A.B")) == ("a b", "ab")
    assert one(spark, X.clean_prediction("x"), x="chair</s><pad>\nfoo") == "chair"
    assert (one(spark, X.trim_question("x"), x="x Question: what? Answer: y"), one(spark, X.trim_answer("x"), x="red Question: z")) == ("what?", "red")
    assert one(spark, X.trim_question("x"), x="Question: Answer: blue") == "blue"
    assert one(spark, X.image_id("x"), x="a/b/COCO_val_0042.jpg") == "0042"
    assert one(spark, X.drive_id("x"), x="https://example.org/file/d/12/view") is None
    assert one(spark, X.parse_task("x"), x="no colon") is None
    assert one(spark, X.unigram_f1("x", "y"), x="", y="a") is None


def test_normalisers_match_restatement(spark):
    rows = strings(400)
    d = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    got = d.select("i", X.answer_punctuation("s").alias("p"), X.answer_words("s").alias("w")).collect()
    for r in got:
        assert r["p"] == punctuation(rows[r["i"]])
        assert r["w"] == words(rows[r["i"]])


def test_null_and_empty(spark):
    d = spark.createDataFrame([(None,), ("",)], "s string")
    for f in (X.clean_caption, X.clean_question, X.answer_punctuation, X.answer_words, X.normalise_answer, X.clean_prediction, X.trim_question, X.trim_answer, X.clean_text):
        assert [r[0] for r in d.select(f("s")).collect()] == [None, ""]


def test_accept_new_is_greedy_in_order(spark):
    assert one(spark, X.accept_new("x"), x=["a red cat", "red", "dog", "a dog", "red cat"]) == ["a red cat", "dog", "a dog"]


def test_fixed_length(spark):
    assert one(spark, X.fix_length("x", 5, 90, 91), x=[1, 2]) == [90, 1, 2, 91, 0]
    assert one(spark, X.fix_length("x", 4, 90, 91), x=[1, 2, 3, 4, 5]) == [90, 1, 2, 91]


def test_merge_and_natural_order(spark):
    assert one(spark, X.merge_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))) == {"a": 2, "b": 3}
    d = spark.createDataFrame([("view_10",), ("view_9",), ("a",)], "n string").orderBy(X.natural_prefix("n"), X.natural_number("n"))
    assert [r["n"] for r in d.collect()] == ["a", "view_9", "view_10"]
