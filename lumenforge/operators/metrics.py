"""Scorecards: answer weights, exact match, consensus accuracy, retrieval recall, classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import answer_punctuation, normalise_answer


def answer_weights(df: DataFrame, key: str, answers: str) -> DataFrame:
    """(key, answer, weight): every repeat of an answer adds one over the number of answers."""
    rows = df.select(key, F.size(answers).alias("_n"), F.explode(answers).alias("answer"))
    return rows.groupBy(key, "answer").agg((F.count("*") / F.max("_n")).alias("weight"))


def exact_match(df: DataFrame, prediction: str, answers: str) -> Column:
    """100 times the share of predictions that are among their answers, as an aggregate."""
    return F.avg(F.array_contains(answers, F.col(prediction)).cast("double")) * 100


def by_group(df: DataFrame, groups: Sequence[str], **scores: Column) -> DataFrame:
    """One row over all and one for each value of each group (A06, A08): (grp, value, n, scores)."""
    sets = [[], *[[g] for g in groups]]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(g) for g in groups]).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), *[s.alias(k) for k, s in scores.items()])
    k = len(groups)
    full = (1 << k) - 1
    name, value = F.lit("All"), F.lit("All")
    for i, g in enumerate(groups):
        hit = F.col("_g") == full - (1 << (k - 1 - i))
        name, value = F.when(hit, g).otherwise(name), F.when(hit, F.col(g).cast("string")).otherwise(value)
    return out.select(name.alias("grp"), value.alias("value"), "n", *scores)


def consensus(prediction: Column, answers: Column) -> Column:
    """Leave-one-out consensus of a prediction among array<struct<answer_id, answer>>.

    For each gold answer, the others are those that differ from it in any field; a third of those that equal
    the prediction counts, at most 1; the mean over the golds. Golds have their marks normalised if they differ at all.
    """
    differ = F.size(F.array_distinct(F.transform(answers, lambda a: a["answer"]))) > 1
    golds = F.transform(answers, lambda a: F.struct(a["answer_id"].alias("answer_id"), F.when(differ, answer_punctuation(a["answer"])).otherwise(a["answer"]).alias("answer")))
    pred = normalise_answer(prediction)
    from ..functions.columns import let

    def score(s: Column) -> Column:
        each = lambda g: F.least(F.lit(1.0), F.size(F.filter(s["g"], lambda o: (o != g) & (o["answer"] == s["p"]))) / F.lit(3.0))
        return F.aggregate(F.transform(s["g"], each), F.lit(0.0), lambda a, x: a + x) / F.size(s["g"])

    return let(F.struct(golds.alias("g"), pred.alias("p")), score)


def direct_accuracy(prediction: Column, answers: Column) -> Column:
    """A third of the answers equal to the prediction, at most 1 (A10)."""
    return F.least(F.lit(1.0), F.size(F.filter(answers, lambda a: a == prediction)) / F.lit(3.0))


def accuracy(prediction: Column | str, target: Column | str) -> Column:
    """Share of equal labels, as an aggregate."""
    p, t = (F.col(c) if isinstance(c, str) else c for c in (prediction, target))
    return F.avg((p == t).cast("double"))


def strict_accuracy(prediction: str, target: str, generated: bool) -> Column:
    """100 times the share of equal answers, predictions normalised where they were generated."""
    p = normalise_answer(F.col(prediction)) if generated else F.col(prediction)
    return F.avg((p == F.col(target)).cast("double")) * 100


def weighted_mean(value: str, weight: str) -> Column:
    """sum(v n) / sum(n), what workers agree on."""
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def rank_golds(scores: DataFrame, query: str, item: str, score: str, gold: Column) -> DataFrame:
    """(query, rank): 0-based best rank of a query's golds, by score, equal ones by the larger item first."""
    ranked = scores.withColumn("_r", F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), F.desc(item))) - 1)
    return ranked.groupBy(query).agg(F.min(F.when(gold, F.col("_r"))).alias("rank"))


def recalls(ranks: DataFrame, rank: str = "rank", at: Sequence[int] = (1, 5, 10), prefix: str = "r") -> DataFrame:
    """100 times the share of ranks below each k, and their mean."""
    cols = [(F.avg((F.coalesce(F.col(rank), F.lit(1 << 30)) < k).cast("double")) * 100).alias(f"{prefix}{k}") for k in at]
    out = ranks.agg(*cols)
    return out.withColumn(f"{prefix}_mean", sum(F.col(f"{prefix}{k}") for k in at) / len(at))


def top_k(df: DataFrame, query: str, score: str, item: str, k: int) -> DataFrame:
    """The k best items of each query, the smaller item first among equals; Spark limits the groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), item))).where(F.col("rank") <= k)


def two_stage(df: DataFrame, query: str, score: str, item: str, k: int, rescore: Column) -> DataFrame:
    """The k best get rescore + score, all others -100."""
    r = F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), item))
    return df.withColumn("final", F.when(r <= k, rescore + F.col(score)).otherwise(-100.0))


def best(df: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """(key, label) of the largest score, the smaller label among equals."""
    return df.groupBy(key).agg(F.max_by(label, F.struct(F.col(score), -F.col(label))).alias(label))


def nearest_label(df: DataFrame, vector: str, centres: DataFrame, label: str, centre: str, name: str, most: int = 10_000) -> DataFrame:
    """df with the label of the centre of largest inner product, rounded to nine digits, the smaller label among equals.

    The centres travel with every task as one row's array, for which they are counted; more than `most` are compared by blocks.
    """
    from ..functions.vectors import dot
    from ..runtime import materialise
    from .blocks import split_top_k

    if centres.count() > most:
        d = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        found = split_top_k(d.select("_row", F.col(vector).alias("_u")), centres.select(F.col(label).alias("_row"), F.col(centre).alias("_u")), 1, "_row", "_u", others=False)
        return d.join(found.select(F.col("q").alias("_row"), F.col("i").cast(centres.schema[label].dataType).alias(name)), "_row", "left").drop("_row")
    table = centres.agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col(centre).alias("c"))).alias("_centres"))
    score = F.transform("_centres", lambda c: F.struct(F.round(dot(vector, c["c"]), 9).alias("s"), (-c["l"]).alias("l")))
    return df.crossJoin(F.broadcast(table)).withColumn(name, -F.array_max(score)["l"]).drop("_centres")  # one row


def answer_ranking(df: DataFrame, query: str, answer: str, first: str, likelihood: str, k: int) -> DataFrame:
    """The answer of the largest likelihood among the k of largest first-token probability."""
    return best(top_k(df, query, first, answer, k), query, likelihood, answer)


def frequent_answers(df: DataFrame, key: str, answer: str, order: str, limit: int = 30, last: str | None = "yes.") -> DataFrame:
    """(key, answer, place): answers by how often they come, then by where first; the first `limit`, and one more at the end."""
    n = df.groupBy(key, answer).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    n = n.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_n"), "_first", answer))).where(F.col("place") <= limit).select(key, answer, "place")
    if last is None:
        return n
    more = n.groupBy(key).agg((F.max("place") + 1).alias("place")).select(key, F.lit(last).alias(answer), "place")
    return n.unionByName(more)
