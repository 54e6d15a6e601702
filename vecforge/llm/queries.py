"""Queries over the shared test tables, one for each operator; digests are derived from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm import ann, embedding_dedup, mixing, packing, quality, repair, sharding, simhash, substring_dedup, toxicity

SHARDS = 40
WORD_VOCABULARY = 49_408


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.hilbert_shards(_table(spark, sf_dir, "documents"), SHARDS)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op3_quality_fourier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(_fold("doc_id", 5) != 0)
    out = quality.scored(_table(spark, sf_dir, "documents"), labels)
    return out.select(F.col("id").alias("doc_id"), (_fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(_table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.removed(_table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_iterative_quantisation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op7_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.stored_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), WORD_VOCABULARY)
    return repair.read_checksums(spark, path, WORD_VOCABULARY).withColumnRenamed("id", "doc_id")


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_fold("doc_id", 3) != 1)
    out = toxicity.scored(docs, toxicity.fit(docs, labels))
    return out.select(F.col("id").alias("doc_id"), (_fold("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_hilbert_shards,
        op2_simhash_deletion_variants,
        op3_quality_fourier_features,
        op4_poisson_mixing,
        op5_suffix_array_dedup,
        op6_iterative_quantisation_dedup,
        op7_repair_token_shards,
        op8_sum_of_squares_packing,
        op9_toxic_segments,
        op10_multi_index_neighbours,
    )
    return {f.__name__: f for f in own}


_OP4 = f"""
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS size FROM documents WHERE doc_id IS NOT NULL GROUP BY source
), weighted AS (
  SELECT source, size, pow(size::DOUBLE, {mixing.POWER}::DOUBLE) AS weight FROM sizes
), rated AS (
  SELECT source, weight / (sum(weight) OVER ()) * (1.0::DOUBLE * (sum(size) OVER ())) / size AS rate FROM weighted
), pmf AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rated, LATERAL (SELECT unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 40) + 1)::BIGINT)) AS k)
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf
), drawn AS (
  SELECT doc_id, source, ('0x' || substr(md5('count|{mixing.SEED}|' || doc_id), 1, {mixing.DIGITS}))::BIGINT::DOUBLE / {float(16**mixing.DIGITS)}::DOUBLE AS u
  FROM documents WHERE doc_id IS NOT NULL
), counted AS (
  SELECT d.doc_id, d.source, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS copies FROM drawn d
), copied AS (
  SELECT doc_id, source, copies::INT AS copies, unnest(range(1, copies + 1))::INT AS copy FROM counted
)
SELECT doc_id, source, copies, copy,
       (row_number() OVER (ORDER BY md5('order|{mixing.SEED}|' || doc_id || '|' || copy), doc_id, copy) - 1)::BIGINT AS position
FROM copied
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_poisson_mixing": _OP4}
