"""Documents to training sequences: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecforge.llm import stages
from vecforge.llm.common import stored

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_near_dedup", stages.drop_similar),
    ("suffix_array_dedup", stages.cut_repeats),
    ("poisson_mixing", stages.mix_sources),
    ("sum_of_squares_packing", stages.pack),
]

#: XXH64, suffix sorting and tokenizers are beyond DuckDB's SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
