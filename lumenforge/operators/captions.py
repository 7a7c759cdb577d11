"""Caption metrics from their papers: BLEU, ROUGE-L and CIDEr over lower-cased word tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _counts(df: DataFrame, key: list[str], words: str, n: int) -> DataFrame:
    return df.select(*key, F.explode(ngrams(F.col(words), n)).alias("g")).groupBy(*key, "g").agg(F.count("*").alias("c"))


def bleu(df: DataFrame, key: str, hypothesis: str, references: str, n_max: int = 4) -> DataFrame:
    """One row (bleu1 .. bleu<n_max>) over the corpus: clipped n-gram precisions, their geometric means, times the brevity penalty against the closest reference length."""
    t = df.select(key, tokens(hypothesis).alias("h"), F.transform(references, tokens).alias("rs"))
    closest = F.array_min(F.transform("rs", lambda r: F.struct(F.abs(F.size(r) - F.size("h")).alias("d"), F.size(r).alias("n"))))["n"]
    sizes = t.agg(F.sum(F.size("h")).alias("hl"), F.sum(closest).alias("rl"), *[F.sum(F.greatest(F.lit(0), F.size("h") - (n - 1))).alias(f"t{n}") for n in range(1, n_max + 1)])
    refs = t.select(key, F.posexplode("rs").alias("_k", "r"))
    out = sizes
    for n in range(1, n_max + 1):
        most = _counts(refs, [key, "_k"], "r", n).groupBy(key, "g").agg(F.max("c").alias("m"))
        hit = _counts(t, [key], "h", n).join(most, [key, "g"]).agg(F.coalesce(F.sum(F.least("c", "m")), F.lit(0)).alias(f"m{n}"))
        out = out.crossJoin(F.broadcast(hit))  # one row each
    bp = F.when(F.col("hl") >= F.col("rl"), 1.0).when(F.col("hl") == 0, 0.0).otherwise(F.exp(1 - F.col("rl") / F.col("hl")))
    logs, cols = F.lit(0.0), []
    for n in range(1, n_max + 1):
        p = F.when(F.col(f"t{n}") > 0, F.col(f"m{n}") / F.col(f"t{n}")).otherwise(0.0)
        logs = logs + F.when(p > 0, F.ln(F.when(p > 0, p).otherwise(1.0))).otherwise(-1e9)
        cols.append((bp * F.exp(logs / n)).alias(f"bleu{n}"))
    return out.select(*cols)


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two arrays: one row of the table at a time, folded within the row."""
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        step = lambda out, j: F.concat(out, F.array(F.when(F.element_at(b, j) == x, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(out, -1)))))
        return F.when(F.size(b) == 0, prev).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(b))), F.array(F.lit(0)), step))

    return F.element_at(F.aggregate(a, zero, row), -1)


def rouge_l(hypothesis: Column | str, references: Column | str, beta: float = 1.2) -> Column:
    """F value of the longest common subsequence, best precision and best recall over the references."""
    from ..functions.columns import let

    h, rs = tokens(hypothesis), F.transform(F.col(references) if isinstance(references, str) else references, tokens)

    def score(s: Column) -> Column:
        lengths = F.transform(s["rs"], lambda r: F.struct(lcs_length(s["h"], r).alias("l"), F.size(r).alias("n")))

        def f(ls: Column) -> Column:
            p = F.array_max(F.transform(ls, lambda x: F.coalesce(F.try_divide(x["l"].cast("double"), F.size(s["h"])), F.lit(0.0))))
            r = F.array_max(F.transform(ls, lambda x: F.coalesce(F.try_divide(x["l"].cast("double"), x["n"]), F.lit(0.0))))
            return let(F.struct(p.alias("p"), r.alias("r")), lambda v: F.when((v["p"] > 0) & (v["r"] > 0), (1 + beta**2) * v["p"] * v["r"] / (v["r"] + beta**2 * v["p"])).otherwise(0.0))

        return let(lengths, f)

    return let(F.struct(h.alias("h"), rs.alias("rs")), score)


def cider(df: DataFrame, key: str, hypothesis: str, references: str, n_max: int = 4, sigma: float = 6.0) -> DataFrame:
    """(key, cider): mean over n of tf-idf cosines with the references, clipped counts and a penalty for length, times 10."""
    t = df.select(key, tokens(hypothesis).alias("h"), F.transform(references, tokens).alias("rs"))
    docs = t.agg(F.count("*").alias("docs"))
    refs = t.select(key, F.posexplode("rs").alias("_k", "r"), F.size("rs").alias("nr"), F.size("h").alias("hl"))
    total = None
    for n in range(1, n_max + 1):
        rc, hc = _counts(refs, [key, "_k"], "r", n), _counts(t, [key], "h", n)
        df_n = rc.select(key, "g").distinct().groupBy("g").agg(F.count("*").alias("d"))
        weigh = lambda x: x.join(df_n, "g", "left").crossJoin(F.broadcast(docs)).withColumn("w", F.col("c") * (F.ln(F.greatest(F.lit(1.0), F.col("docs"))) - F.ln(F.greatest(F.lit(1.0), F.coalesce("d", F.lit(0)).cast("double")))))  # noqa: B023, E731
        hw, rw = weigh(hc).select(key, "g", F.col("w").alias("hw")), weigh(rc).select(key, "_k", "g", F.col("w").alias("rw"))
        hn = hw.groupBy(key).agg(F.sqrt(F.sum(F.col("hw") * F.col("hw"))).alias("hn"))
        rn = rw.groupBy(key, "_k").agg(F.sqrt(F.sum(F.col("rw") * F.col("rw"))).alias("rn"))
        dots = rw.join(hw, [key, "g"]).groupBy(key, "_k").agg(F.sum(F.least("hw", "rw") * F.col("rw")).alias("dot"))
        s = refs.join(dots, [key, "_k"], "left").join(hn, key, "left").join(rn, [key, "_k"], "left")
        length = F.exp(-F.pow(F.col("hl") - F.size("r"), F.lit(2.0)) / (2 * sigma**2))
        sim = F.coalesce(F.when((F.col("hn") > 0) & (F.col("rn") > 0), F.col("dot") / (F.col("hn") * F.col("rn"))), F.lit(0.0)) * length
        part = s.groupBy(key).agg((F.sum(sim) / F.max("nr")).alias("v"))
        total = part if total is None else total.unionByName(part)
    return total.groupBy(key).agg((F.sum("v") / n_max * 10).alias("cider"))


def external_metric(df: DataFrame, key: str, hypothesis: str, references: str, make: Callable[[], Callable[[str, list[str]], float]], name: str = "score") -> DataFrame:
    """(key, name): a metric that the caller injects, such as METEOR or SPICE with their word nets; make() is called once a task."""
    from .scorers import score

    def scorer() -> Callable:
        metric = make()
        return lambda b: b.assign(**{name: [float(metric(h, list(rs))) for h, rs in zip(b[hypothesis], b[references], strict=True)]})[[key, name]]

    slim = df.select(key, hypothesis, references)
    return score(slim, scorer, f"{key} {df.schema[key].dataType.simpleString()}, {name} double")


def caption_score(cider_mean: Column, bleu4: Column) -> Column:
    """What the best epoch is chosen by."""
    return cider_mean + bleu4


__all__ = ["bleu", "caption_score", "cider", "external_metric", "lcs_length", "ngrams", "rouge_l", "tokens"]
