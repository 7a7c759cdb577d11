"""A training corpus out of raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes rows with null or repeated ids, null, empty and very long texts, rows that are the same in every column, empty
tables and further columns of any name; what each does with them is said below and where its operator is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm import bpe, minhash, mixing, quality, secrets
from lumenforge.llm.common import materialise
from lumenforge.llm.queries import vocabulary_path
from lumenforge.runtime import ship

#: EM, MinHash and the mix settle over the whole table; SQL has no plain form of them, so tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, whole; null and empty texts go, each of equal rows has the same verdict, a posterior of one half keeps."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id: five-word shingles of whole texts, similarity 0.8 or more. Of equal rows one stays; rows that share an id, or have none, are told apart by content."""
    return minhash.drop_duplicates(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked wherever they stand; n_chars follows the text and is null where that is."""
    return secrets.redact(docs, vocabulary_file=vocabulary_path()).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, whole, as often as the mix takes them; targets are met with null, repeated and equal rows too."""
    return mixing.mix_documents(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and decoded text; a null text has no tokens."""
    return bpe.encode_documents(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("bpe encode", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
