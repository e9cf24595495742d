"""The queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: The rules in op1's SQL, which is kept as it was: its words for the two rules under ``net`` aren't the contract's.
SQL_URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]
TOXIC_CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_encode

    return bpe_encode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents"), min_bytes=200)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources, word_count
    from .scratch import Scratch

    sized = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = Scratch(spark, "sizes").save(sized, "sizes")
    mixed = mix_sources(sized, (3.0, 1.0, 2.0), share=1.5, epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train

    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, _table(spark, sf_dir, "labels"), TOXIC_CATEGORIES))
    if "low_quality" not in scored.columns:
        scored = scored.withColumn("low_quality", F.lit(0.0))
    return scored.select("doc_id", "low_quality", "toxic", (F.col("toxic") >= 0.5).alias("is_toxic"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = train(docs.where(~held))
    told = identify(docs, model)
    return told.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), k=20, step=20)


def op9_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media: every row of ``embeddings`` is played as a recording."""
    from .audio import align_recordings, fingerprint, melody
    from .scratch import bound_batches

    bound_batches(spark, 256)
    prints = fingerprint(melody(_table(spark, sf_dir, "embeddings")), "id", "media")
    return align_recordings(prints, step=20).withColumnRenamed("id", "vec_id")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import token_round_trip

    return token_round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN, end=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """For the others see tests/llm: brute force, round trips and held-out accuracy."""
    from . import mixing, oracles

    return {
        "op1_url_filters": oracles.url_filters(SQL_URL_RULES),
        "op4_minhash_near_dedup": oracles.near_duplicates(width=4, percent=80),
        "op5_suffix_array_dedup": oracles.suffix_dedup(200),
        "op6_source_mixing": oracles.source_mixing((3.0, 1.0, 2.0), 1.5, 2.0, 17, mixing.BUCKET),
    }
