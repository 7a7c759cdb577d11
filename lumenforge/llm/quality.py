"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, materialise

WINDOW = 8
#: Frequent function words of the four languages of the corpus; rule `function_words` counts them.
FUNCTION_WORDS = "the of and to in is that for it with as on be by are this was der die und das den von zu mit ist im nicht ein eine auf für dem des sich le la les de du des et est en que qui un une dans pour par sur pas au el los las del y se con su para una no".split()


def window_hashes(words: Column, window: int) -> Column:
    """A hash for each window of the array: every word is hashed once, then spans of 1, 2, 4, .. words are put together, so a window costs as many steps as its length has bits."""
    n = F.size(words)

    def joined(a: Column, b: Column, at: int, length: int) -> Column:
        """Hashes of spans of `length` words: those of a, and those of b that begin `at` words on."""
        k = n - (length - 1)
        return F.zip_with(F.slice(a, 1, k), F.slice(b, at + 1, k), lambda x, y: F.xxhash64(x, y))

    def build(span: Column, length: int, out: Column | None, done: int) -> Column:
        if window & length:
            out, done = (span, length) if out is None else (joined(out, span, done, done + length), done + length)
        if done == window:
            return out
        twice = joined(span, span, length, 2 * length)
        if out is None:
            return let(twice, lambda x: build(x, 2 * length, None, 0))
        return let(F.struct(twice.alias("x"), out.alias("o")), lambda s: build(s["x"], 2 * length, s["o"], done))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: build(h, 1, None, 0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of `window` words that occurs twice or more in the array."""
    n = F.size(words)
    hashes = window_hashes(words, window)

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            twin = F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
            return F.sort_array(F.filter(twin, lambda x: x.isNotNull()))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(pairs, lambda s: let(starts(s), length))

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n <= window, F.lit(0).cast("long")).otherwise(found)


def text_statistics(df: DataFrame, text_col: str, **keep: Column) -> DataFrame:
    """A row for each document: the contract's counts and those that the rules vote on, after the columns to keep."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = df.select(*[c.alias(k) for k, c in keep.items()], text.alias("t"))
    d = d.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    return d.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        (F.length("t") - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"[.!?…][\"'”»)]*\s*$"))).cast("long").alias("n_closed"),
        count("!!").alias("n_shouts"),
        count(r"\p{Lu}").alias("n_upper"),
        F.size(F.filter("w", lambda x: x.isin(*FUNCTION_WORDS))).cast("long").alias("n_function"),
    )


def _share(part: str, whole: str, good, bad) -> Column:
    """1 where the share passes `good`, -1 where it passes `bad`, else 0; 0 where the whole is 0."""
    x = F.col(part) / F.col(whole)
    return F.when(F.col(whole) == 0, 0).when(bad(x), -1).when(good(x), 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: 1 is a vote for good text, -1 for bad, 0 abstains. Rules that look for a defect abstain where they find none."""
    some = lambda x: F.lit(False)
    return {
        "length": F.when(F.col("n_words") < 20, -1).when(F.col("n_words") >= 60, 1).otherwise(0),
        "word_length": _share("word_chars", "n_words", some, lambda x: (x < 2) | (x > 16)),
        "symbols": _share("n_symbols", "n_words", some, lambda x: x > 0.4),
        "repeats": _share("n_repeat_words", "n_words", some, lambda x: x > 0.3),
        "lines": _share("n_dup_lines", "n_lines", some, lambda x: x > 0.4),
        "closing": _share("n_closed", "n_lines", lambda x: x > 0.6, lambda x: x < 0.15),
        "shouts": _share("n_shouts", "n_words", some, lambda x: x > 0.2),
        "capitals": _share("n_upper", "word_chars", some, lambda x: x > 0.4),
        "function_words": _share("n_function", "n_words", lambda x: x > 0.12, lambda x: x < 0.04),
    }


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, smooth: float = 1.0, prior: float = 0.8) -> tuple[float, list[list[float]]]:
    """Expectation-maximisation over counted vote patterns: (log odds of good, log likelihood ratios [rule][vote + 1]).

    Rules are independent given the class; each has, for either class, a probability of each vote. The
    posterior starts from the majority of the votes, which fixes what the classes mean. `smooth` is added
    to every count; to abstain carries no weight, and no vote counts against its own sign.
    """
    m = len(patterns[0][0]) if patterns else 0
    post = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(v)))) for v, _ in patterns]
    odds, ratio = math.log(prior / (1 - prior)), [[-1.0, 0.0, 1.0] for _ in range(m)]
    for _ in range(rounds):
        good = sum(p * n for p, (_, n) in zip(post, patterns, strict=True))
        bad = sum((1 - p) * n for p, (_, n) in zip(post, patterns, strict=True))
        odds = math.log((good + smooth) / (bad + smooth))
        ratio = []
        for j in range(m):
            table = [[smooth, smooth] for _ in range(3)]
            for p, (v, n) in zip(post, patterns, strict=True):
                table[v[j] + 1][0] += p * n
                table[v[j] + 1][1] += (1 - p) * n
            per = [math.log(table[k][0] / (good + 3 * smooth)) - math.log(table[k][1] / (bad + 3 * smooth)) for k in (0, 2)]
            ratio.append([min(0.0, per[0]), 0.0, max(0.0, per[1])])  # rules are taken to be better than chance
        post = [1 / (1 + math.exp(-max(-500.0, min(500.0, odds + sum(r[x + 1] for r, x in zip(ratio, v, strict=True)))))) for v, _ in patterns]
    return odds, ratio


def _verdicts(stats: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(stats with votes, whether the base rule fails, posterior of good)."""
    rules = votes()
    voted = stats.withColumns({f"v_{k}": v for k, v in rules.items()})
    names = [f"v_{k}" for k in rules]
    counted = sorted((tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).agg(F.count("*")).collect())
    odds, ratio = fit_votes(counted)
    score = F.lit(odds)
    for name, r in zip(names, ratio, strict=False):
        score = score + F.when(F.col(name) == -1, r[0]).when(F.col(name) == 1, r[2]).otherwise(0.0)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted, base, 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), score))))


def keep_good(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df that judge() keeps, with all their columns.

    Null and empty texts have no words and go; rows may be repeated, and each has its own verdict; an empty table stays empty; the
    columns of df may have any names; texts of any length are read whole; a posterior of exactly the threshold keeps. The rows go to the shared
    folder with their counts beside them, so texts are read by the rules once and never shuffled; then those that are kept are read back.
    """
    stats = materialise(text_statistics(df, text_col, row=F.struct(*[F.col(f"`{c}`") for c in df.columns])), "quality")
    voted, base, quality = _verdicts(stats)
    return voted.where(~base & (quality >= threshold)).select("row.*")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior) for every row.

    A null text has no words and fails the base rule, as an empty one does; ids may be null or repeated, each row has its own verdict;
    other columns, whatever their names, are not looked at; an empty table gives no rows; texts of any length are read whole; a posterior of
    exactly the threshold keeps. The texts are read once, by built-in
    expressions within each row; the counts go to the shared folder. The only thing to meet in one
    place is the count of each pattern of votes: at most 3 ** 9 rows, however many documents there are.
    """
    stats = materialise(text_statistics(df, text_col, id=F.col(id_col)), "quality")
    voted, base, quality = _verdicts(stats)
    names = [c for c in voted.columns if c.startswith("v_")]
    return voted.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & (quality >= threshold)).alias("kept"),
        quality.alias("posterior"),
        *names,
    )
