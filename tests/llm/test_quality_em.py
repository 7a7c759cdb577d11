"""The verdict of the quality rules against rules and expectation-maximisation restated over rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from lumenforge.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    """What the rules look at, in plain Python."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    closed = sum(bool(re.search(r"[.!?…][\"'”»)]*[ \t\n\x0b\f\r]*$", x)) for x in lines)
    return {
        "words": len(words), "chars": sum(map(len, words)), "symbols": len(re.findall(r"[#*$%&|<>]", text)), "dup": len(lines) - len(set(lines)), "repeat": len(inside), "lines": len(lines),
        "closed": closed, "shouts": text.count("!!"), "upper": sum(c.isupper() for c in text), "function": sum(w in set(quality.FUNCTION_WORDS) for w in words),
    }


def ballot(s):
    share = lambda a, b, good, bad: 0 if not s[b] else -1 if bad(s[a] / s[b]) else 1 if good(s[a] / s[b]) else 0
    never = lambda x: False
    return (
        -1 if s["words"] < 20 else 1 if s["words"] >= 60 else 0,
        share("chars", "words", never, lambda x: x < 2 or x > 16),
        share("symbols", "words", never, lambda x: x > 0.4),
        share("repeat", "words", never, lambda x: x > 0.3),
        share("dup", "lines", never, lambda x: x > 0.4),
        share("closed", "lines", lambda x: x > 0.6, lambda x: x < 0.15),
        share("shouts", "words", never, lambda x: x > 0.2),
        share("upper", "chars", never, lambda x: x > 0.4),
        share("function", "words", lambda x: x > 0.12, lambda x: x < 0.04),
    )


def posteriors(ballots, rounds=50):
    """EM row by row: classes start from the majority of votes, every class has a probability of each vote of each rule."""
    logistic = lambda x: 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))
    p = [logistic(math.log(4) + sum(b)) for b in ballots]
    for _ in range(rounds):
        good = sum(p)
        bad = len(p) - good
        odds, ratio = math.log((good + 1) / (bad + 1)), []
        for j in range(9):
            weight = {}
            for vote in (-1, 1):
                g = 1 + sum(x for x, b in zip(p, ballots, strict=True) if b[j] == vote)
                h = 1 + sum(1 - x for x, b in zip(p, ballots, strict=True) if b[j] == vote)
                r = math.log(g / (good + 3)) - math.log(h / (bad + 3))
                weight[vote] = min(0.0, r) if vote < 0 else max(0.0, r)
            ratio.append({**weight, 0: 0.0})
        p = [logistic(odds + sum(r[v] for r, v in zip(ratio, b, strict=True))) for b in ballots]
    return p


def test_verdicts(spark):
    r = random.Random(11)
    word = lambda: r.choice(["the", "of", "and", "is", "house", "river", "walks", "und", "le", "quiet", "stones", "X9"])
    texts = []
    for k in range(160):
        kind = r.choice(["prose", "prose", "prose", "short", "symbols", "repeats", "lines", "shouting", "list", "long words"])
        words = [word() for _ in range(r.randint(5, 15) if kind == "short" else r.randint(25, 130))]
        if kind == "symbols":
            words = [w + r.choice("#$%&*") for w in words]
        if kind == "shouting":
            words = [w.upper() + "!!" for w in words]
        if kind == "long words":
            words = ["".join(r.choice("abcdef") for _ in range(20)) for _ in words]
        text = " ".join(words)
        if kind == "prose":
            text = ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
        if kind == "repeats":
            text = " ".join(words[:12] * 6)
        if kind == "lines":
            text = "\n".join([" ".join(words[:6])] * 9)
        if kind == "list":
            text = "\n".join(words)
        texts.append(text)
    texts += [None, "", texts[0], texts[0]]
    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    stats = [statistics(t) for t in texts]
    want = posteriors([ballot(s) for s in stats])
    for x in rows:
        s, p = stats[x["doc_id"]], want[x["doc_id"]]
        base = s["words"] < 20 or 100 * s["repeat"] > 30 * s["words"]
        assert x["posterior"] == pytest.approx(p, abs=1e-9) and x["base_failed"] == base and x["kept"] == (not base and p >= 0.5), texts[x["doc_id"]]
    assert 20 < sum(x["kept"] for x in rows) < len(rows) - 20


def test_repeats_of_any_window(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    lists = [[r.choice("abc") for _ in range(r.randint(0, 40))] for _ in range(120)] + [[], ["a"] * 30]
    d = spark.createDataFrame(list(enumerate(lists)), "k int, w array<string>")
    for window in (2, 3, 5, 7, 8, 13):
        got = {x["k"]: x["n"] for x in d.select("k", quality.repeated_words(F.col("w"), window).alias("n")).collect()}
        for k, words in enumerate(lists):
            spans = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
            n, inside = Counter(spans), set()
            for i, s in enumerate(spans):
                if n[s] > 1:
                    inside |= set(range(i, i + window))
            assert got[k] == len(inside), (window, words)
