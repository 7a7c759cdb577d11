"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise, release, row_hash, sized

#: Copies of one row that one task makes.
CHUNK = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Targets of sources (skey, snull, source_size, weight): shares of the budget by weight, none above max_epochs times its size.

    Clamping what is above its cap and sharing the excess by weight, again and again until nothing is
    above, ends at min(cap, level * weight). Walking the sources in the order in which they hit their
    caps, the level is the largest of (budget - caps before) / (weights from here on), so one pass over
    the sources' own rows finds it. Where all caps together are below the budget, every source stops at its cap.
    """
    order = W.orderBy(F.col("cap") / F.col("weight"), "snull", "skey")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = sources.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    total = F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (F.lit(float(budget)) * total - F.col("caps_before")) / F.col("weight_left"))
    s = s.withColumn("level", F.max("level").over(W.partitionBy()))
    return s.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).select("skey", "snull", "source_size", "weight", "target")


def _digest(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))))


def _keys(id_col: str, source_col: str, seed: int, content: Column) -> dict[str, Column]:
    """Source and place in its seeded order: by digest of the id, then by content, so that only rows that are the same share a place."""
    source = F.col(f"`{source_col}`")
    return {"skey": F.coalesce(source.cast("string"), F.lit("")), "snull": source.isNull(), "d": _digest(id_col, seed), "h": content}


def _planned(df: DataFrame, keys: dict[str, Column], id_col: str, text_col: str, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """(skey, snull, d, h, id, size, m, source_size, target, whole, more) a place: m rows share it, all are taken `whole` times, `more` of them once more.

    Places are dealt by ranges of the order, which a sample makes even whatever the sources', ids' and contents' frequencies; the
    words before a range are the sums of those before it, one row for each range and source.
    """
    src = ["skey", "snull"]
    rows = df.select(*[c.alias(k) for k, c in keys.items()], F.col(f"`{id_col}`").alias("id"), word_count(F.col(f"`{text_col}`")).alias("size"))
    places = materialise(rows.groupBy(*rows.columns).agg(F.count("*").alias("m")), "mix-places")
    dealt = materialise(places.repartitionByRange("snull", "skey", "d", "h").withColumn("part", F.spark_partition_id()), "mix-order")
    words = F.col("size") * F.col("m")
    ranges = materialise(dealt.groupBy(*src, "part").agg(F.sum(words).alias("words")), "mix-ranges")
    release(places)
    sources = ranges.groupBy(*src).agg(F.sum("words").alias("source_size"))
    number = F.row_number().over(W.orderBy("snull", "skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    sources = materialise(water_fill(sources.withColumn("weight", weight), budget, max_epochs), "mix-sources")
    ranges = ranges.withColumn("base", F.coalesce(F.sum("words").over(W.partitionBy(*src).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("words")
    inner = dealt.withColumn("before", F.coalesce(F.sum(words).over(W.partitionBy("part", *src).orderBy("d", "h", "id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = inner.join(ranges.join(sources, src), [*src, "part"]).withColumn("whole", whole.cast("int"))
    missing = F.col("target") - F.col("whole") * F.col("source_size")
    first = 2 * (F.col("base") + F.col("before")) + F.col("size")
    # the j-th of m equal rows is in if first + 2 * j * size < 2 * missing
    some = F.greatest(F.lit(0), F.least(F.col("m"), F.ceil((2 * missing - first) / F.nullif(2 * F.col("size"), F.lit(0)))))
    more = F.when(~(first < 2 * missing) | (F.col("whole") + 1 > F.lit(float(max_epochs))), 0).when((F.col("m") == 1) | (F.col("size") == 0), F.col("m")).otherwise(some)
    return out.withColumn("more", more.cast("long")).drop("base", "before", "part")


def _times(df: DataFrame, n: Column) -> DataFrame:
    """Every row n times; where that is more than CHUNK, by several tasks."""
    d = df.withColumn("_n", n).where("_n > 0")
    few = d.where(F.col("_n") <= CHUNK)
    many = d.where(F.col("_n") > CHUNK).withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / F.lit(float(CHUNK))).cast("int") - 1)))
    many = many.withColumn("_n", F.least(F.lit(CHUNK), F.col("_n") - F.col("_k") * F.lit(CHUNK))).repartition("_k").drop("_k")
    return few.unionByName(many).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long")))).drop("_n")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """How often each row goes into the mix: (id, source, size, source_size, target, copies int, taken long).

    size: words of the text (null: 0), of any length. Sources in code point order, null last, weigh weights[0],
    weights[1], ... again and again, and share budget times the words of all rows. A row is taken
    floor(target / source_size) times, and once more if it comes early in its source's seeded order:
    rows are in as long as their middle lies before the words still missing, so a source's taken words
    are within half a document of its target, and no row is taken more than max_epochs times. The seeded
    order is that of md5(seed:id), so reruns agree; rows that share an id (or have none) are ordered by a hash of the text, and
    of rows that are the same as many are taken as it takes. Rows without words are taken as often as their order says. Empty
    tables give no rows; other columns, whatever their names, are not looked at. Sources are ordered in one task, one row each: meant for
    up to some millions of them; their rows are spread, however many one source, id or text has.
    """
    keys = _keys(id_col, source_col, seed, row_hash(df, [text_col]))
    plan = _planned(df, keys, id_col, text_col, weights, budget, max_epochs)
    once = _times(plan.withColumn("copies", F.col("whole") + 1), F.col("more")).unionByName(_times(plan.withColumn("copies", F.col("whole")), F.col("m") - F.col("more")))
    return once.select(
        F.col("id").alias(id_col),
        F.when(~F.col("snull"), F.col("skey")).alias(source_col),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def mix_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """The rows of df as often as mix_sources() takes them, with all their columns, whatever their names.

    A source's decision is its whole takes and the last place of its order that is taken once more, so the
    texts meet one row for each source and are not shuffled. Places are those of mix_sources(), rows that share an id being ordered by all their
    columns; where only some of the rows at the last place are in, they are the same in every column, and one stands for them. Null
    texts have no words; an empty table stays empty.
    """
    keys = _keys(id_col, source_col, seed, row_hash(df, df.columns))
    plan = _planned(df, keys, id_col, text_col, weights, budget, max_epochs)
    place = F.struct("d", "h")
    last = plan.groupBy("skey", "snull").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("more") > 0, place)).alias("last"), F.max_by(F.struct("more", "m"), F.when(F.col("more") > 0, place)).alias("at"))
    last = materialise(last.select("skey", "snull", "whole", "last", "at.more", "at.m"), "mix-cuts")
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])
    met = packed.join(sized(last), ["skey", "snull"]).withColumn("cut", (place == F.col("last")) & (F.col("more") < F.col("m")))
    extra = F.coalesce((place <= F.col("last")) & ~F.col("cut"), F.lit(False)).cast("int")
    taken = met.withColumn("n", F.col("whole") + extra).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row")
    some = met.where("cut").groupBy("skey", "snull").agg(F.first("row").alias("row"), F.first("more").alias("more"))
    return taken.unionByName(_times(some, F.col("more")).select("row")).select("row.*")
