"""The operators as stages of a corpus pipeline: documents in, documents out; the last gives packed pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm import mixing, packing, shingles, simhash, substring_dedup, toxicity

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated chance of being toxic is below ``TOXIC_FROM``; the same labels train as in the query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return toxicity.filtered(docs, toxicity.fit(docs, labels), TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one with the smallest id."""
    return simhash.deduplicated(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What ``drop_near_copies`` leaves, with one document of each group of texts that share 0.8 of their five-word shingles."""
    return shingles.deduplicated(drop_near_copies(spark, docs, sf_dir))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that also start elsewhere; n_chars follows the text."""
    return substring_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their source's rate, in shuffled order."""
    return mixing.shuffled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
