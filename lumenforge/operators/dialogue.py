"""Dialogue contexts, prompts and token sequences over ordered turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefixes(df: DataFrame, conv: str, turn: str, values: Sequence[str], name: str = "history", last: int | None = None) -> DataFrame:
    """Each turn with the ones before it as an array of structs, all or the last few."""
    w = W.partitionBy(conv).orderBy(turn).rowsBetween(W.unboundedPreceding if last is None else -last, -1)
    return df.withColumn(name, F.collect_list(F.struct(turn, *values)).over(w))


def last_as_target(df: DataFrame, conv: str, turn: str, values: Sequence[str]) -> DataFrame:
    """One row for a dialogue: its last turn, and all before as context."""
    turns = F.array_sort(F.collect_list(F.struct(turn, *values)))
    d = df.groupBy(conv).agg(turns.alias("_t"))
    return d.select(conv, F.slice("_t", 1, F.size("_t") - 1).alias("context"), F.element_at("_t", -1).alias("target"))


def running_index(df: DataFrame, scene: str, name: str, *order: str) -> DataFrame:
    """How many of the same name came before in the scene."""
    return df.withColumn("running", (F.row_number().over(W.partitionBy(scene, name).orderBy(*order)) - 1).cast("int"))


def speaker(turn: Column) -> Column:
    """By turns the first and the second speaker."""
    return F.when(turn % 2 == 0, "speaker1").otherwise("speaker2")


def conversation_prompt(messages: Column, system: str = "", sep: str = "\n", sep2: str = "\n") -> Column:
    """A conversation array<struct<role, message>> as one text: separators by turns, an empty message ends with a colon."""
    line = lambda m, i: F.when(F.coalesce(m["message"], F.lit("")) == "", F.concat(m["role"], F.lit(":"))).otherwise(F.concat(m["role"], F.lit(": "), m["message"], F.when(i % 2 == 0, sep).otherwise(sep2)))
    return F.concat(F.lit(system + sep), F.array_join(F.transform(messages, line), ""))


def chat_log(df: DataFrame, conv: str, turn: str, question: str, answer: str, last: int) -> DataFrame:
    """(conv, log): the last few question-answer pairs as lines; a question without an answer stays open."""
    pair = F.concat(F.lit("Question: "), F.col(question), F.lit("\nAnswer:"), F.coalesce(F.concat(F.lit(" "), F.col(answer)), F.lit("")))
    d = df.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), pair.alias("p")))).alias("_t"))
    kept = F.slice("_t", F.greatest(F.lit(1), F.size("_t") - (last - 1)), last)
    return d.select(conv, F.array_join(F.transform(kept, lambda x: x["p"]), "\n").alias("log"))


def pair_messages(df: DataFrame, conv: str, pos: str, message: str) -> DataFrame:
    """(conv, pair, user, reply): even places open a pair, odd ones fill it."""
    d = df.withColumn("pair", F.floor(F.col(pos) / 2))
    return d.groupBy(conv, "pair").agg(F.max(F.when(F.col(pos) % 2 == 0, F.col(message))).alias("user"), F.max(F.when(F.col(pos) % 2 == 1, F.col(message))).alias("reply"))


def chunk_captions(df: DataFrame, key: str, pos: str, caption: str, chunk: int, total: int) -> DataFrame:
    """(key, part, captions): every `chunk` captions in one; a shorter last part stays only if it ends at `total`."""
    d = df.where(F.col(pos) < total).withColumn("part", F.floor(F.col(pos) / chunk).cast("int"))
    d = d.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(caption).alias("c")))).alias("_c"), F.count("*").alias("_n"), F.max(pos).alias("_last"))
    return d.where((F.col("_n") == chunk) | (F.col("_last") == total - 1)).select(key, "part", F.array_join(F.transform("_c", lambda x: x["c"]), " ").alias("captions"))


def chat_messages(system: str, examples: Sequence[tuple[str, str]], question: Column) -> Column:
    """array<struct<role, content>>: system, few-shot pairs, the question."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    fixed = [one("system", F.lit(system))]
    for q, a in examples:
        fixed += [one("user", F.lit(q)), one("assistant", F.lit(a))]
    return F.array(*fixed, one("user", question))


def scene_description(df: DataFrame, scene: str, name: str, order: str, centre: Sequence[Column], limit: int = 50) -> DataFrame:
    """(scene, description): lines <name>(k): [x, y, z] of the first boxes in order."""
    first = df.withColumn("_r", F.row_number().over(W.partitionBy(scene).orderBy(order))).where(F.col("_r") <= limit)
    d = running_index(first, scene, name, "_r")
    line = F.concat(F.lit("<"), F.col(name), F.lit(">("), F.col("running").cast("string"), F.lit("): ["), F.concat_ws(", ", *[F.bround(c, 3).cast("string") for c in centre]), F.lit("]"))
    return d.groupBy(scene).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))), lambda x: x["l"]), "\n").alias("description"))


def view_prompt(df: DataFrame, key: str, view: str, caption: str) -> DataFrame:
    """(key, prompt): captions of an object's views in order as one text in one line."""
    d = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(view).alias("v"), F.col(caption).alias("c")))).alias("_c"))
    return d.select(key, F.trim(F.replace(F.array_join(F.transform("_c", lambda x: x["c"]), " "), F.lit("\n"), F.lit(" "))).alias("prompt"))


def token_sequence(caption: Column, history: Column, answer: Column, eos: int, cap: int, speaker1: int, speaker2: int) -> Column:
    """struct<input_ids, token_type_ids, labels> of caption, history array<array<int>> and answer, each ended; only the answer is to learn, the rest -1."""
    end = lambda s: F.concat(s, F.array(F.lit(eos)))
    turns = F.concat(F.transform(history, end), F.array(end(answer)))
    first = end(caption)
    ids = F.concat(first, F.flatten(turns))
    types = F.concat(F.array_repeat(F.lit(cap), F.size(first)), F.flatten(F.transform(turns, lambda s, i: F.array_repeat(F.when(i % 2 == 1, speaker2).otherwise(speaker1), F.size(s)))))
    labels = F.concat(F.array_repeat(F.lit(-1), F.size(ids) - F.size(end(answer))), end(answer))
    return F.struct(ids.alias("input_ids"), types.alias("token_type_ids"), labels.alias("labels"))


def context_for_answers(df: DataFrame, key: str, answers: str, captions: str) -> DataFrame:
    """(key, contexts): for each answer in order the first caption that mentions it and isn't used yet."""
    none = F.array().cast("array<string>")
    pick = lambda used, a: F.element_at(F.concat(F.filter(captions, lambda c: c.contains(a) & ~F.array_contains(used, c)), F.array(F.lit(None).cast("string"))), 1)
    fold = F.aggregate(answers, none, lambda used, a: F.array_compact(F.concat(used, F.array(pick(used, a)))))
    return df.select(key, fold.alias("contexts"))


def first_captions(df: DataFrame, key: str, caption: str, answers: Sequence[str]) -> DataFrame:
    """(key, answers, captions) of every key for context_for_answers(): of each answer the first different captions that mention it, in order.

    An answer finds at most len(answers) - 1 captions used, so the first len(answers) that mention it hold its pick,
    whatever the length of the captions or the number of a key's rows; no key's captions are gathered whole.
    """
    a = F.array(*[F.lit(x) for x in answers])
    held = df.select(F.col(key).alias("_key"), F.col(caption).alias("_caption"), F.explode(F.array_distinct(a)).alias("_answer")).where(F.col("_caption").contains(F.col("_answer")))
    w = W.partitionBy("_key", "_answer").orderBy("_caption")
    first = held.withColumn("_place", F.dense_rank().over(w)).where(F.col("_place") <= len(answers))
    first = first.groupBy("_key").agg(F.array_sort(F.collect_set("_caption")).alias("captions"))
    keys = df.select(key).distinct()
    none = F.array().cast("array<string>")
    return keys.join(first, keys[key].eqNullSafe(first["_key"]), "left").select(key, a.alias("answers"), F.coalesce("captions", none).alias("captions"))


def inverted_index(df: DataFrame, key: str, text: str, word: str = "word") -> DataFrame:
    """(word, keys): the sorted distinct keys of the texts that hold each word."""
    from .captions import tokens

    return df.select(key, F.explode(F.array_distinct(tokens(text))).alias(word)).groupBy(word).agg(F.array_sort(F.collect_set(key)).alias("keys"))
