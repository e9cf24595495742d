"""A corpus pipeline of five stages over ``documents``.

``STAGES`` holds (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns the next stage's documents, the last one a digest of the
encoded corpus.  ``run`` writes each stage's rows to shared storage and reads
them again.  A stage's models and statistics come from what its predecessor
kept, except that toxicity also reads the table of labels.

Ids may be null or repeat, and columns beside those of ``documents`` are dropped
by the first stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, mixing, near_dup, queries, suffix_dedup, toxicity
from sparkloom.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain finds toxic go; all others stay as they are.

    Null and empty texts are judged as texts without a known word.  Without a
    labelled document nothing is learned and all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels, queries.TOXIC_CATEGORIES)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of smallest id.

    Five-word shingles and a similarity of 0.8.  Documents without words are in
    no group and stay.  An id that stands for several texts has each of them
    judged; of its rows that are copies or near-duplicates, one stays.
    """
    judged = near_dup.judge(docs, width=5, percent=80).where("kept and doc_id is not null")
    stay = judged.groupBy("doc_id", "group_key", F.when(F.col("group_key").isNull(), F.col("text_hash")).alias("alone")).agg(F.min("text_hash").alias("text_hash"))
    left = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    named = left.join(stay.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return named.unionByName(left.where("doc_id is null")).select(*COLUMNS)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 that occur twice go; every document stays, if only with what is left.

    A null text stays null, also in ``n_chars``.  Repeated rows of 200 bytes or
    more lose their whole text.
    """
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), min_bytes=200)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy.

    A null source is one of its own.  A null text has size 0 and is taken like
    any other document of its source; with a source of size 0 nothing is taken.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS), (3.0, 1.0, 2.0), share=1.5, epochs=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, and the decoded text's; a null text has no tokens."""
    import public_tokenizers

    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_strings),
    ("source_mixing", mix),
    ("byte_bpe", encode),
]

#: Trained models, byte-level encoding and seeded hashes can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
