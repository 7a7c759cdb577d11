"""The queries over the corpus tables, with production parameters, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship
from . import bpe, embed_dedup, html_extract, licenses, minhash, mixing, panes, pii, quality, secrets, sharding, warc, whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """The public byte-level vocabulary; its package is only needed where no path is given."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_embeddings(_table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2)


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary_file: str | None = None) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary_file or vocabulary_path())


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str, vocabulary_file: str | None = None) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"), vocabulary_file=vocabulary_file or vocabulary_path())


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op12_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.revise_panes(_table(spark, sf_dir, "clicks"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(_table(spark, sf_dir, "embeddings"))


def base_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op13_whitening: the fit's size and exact deviations."""
    return op13_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract fixes of op3_quality, which SQL can say too."""
    return op3_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract fixes of op4_licenses."""
    return op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract fixes of op5_pii."""
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract fixes of op10_secrets."""
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if (k.startswith("op") and k[2].isdigit()) or k.startswith("base_")}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.SQL)
