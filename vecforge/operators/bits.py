"""Bit and storage accounting as column expressions and joins over a layer table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the two 16-bit numbers stored with each vector. Fixed value.
OVERHEAD = 32
#: Tokens of the long-context report. Fixed value.
CONTEXT = 131_072


def bits_per_block(variant: Column | str, q: Column) -> Column:
    """D4 loses one bit to its parity, E8 none: 4 log2(2Q+1) - 1 and 8 log2(2Q+1)."""
    levels = F.log2(2 * q + 1)
    return F.when(_col(variant) == "d4", 4 * levels - 1).when(_col(variant) == "e8", 8 * levels)


def _col(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def lattice_bits(variant: Column | str, dims: Column, q: Column) -> Column:
    """Bits of a coded vector: whole bits for each block, and the overhead."""
    size = F.when(_col(variant) == "d4", 4).when(_col(variant) == "e8", 8)
    return (F.floor(dims / size) * F.ceil(bits_per_block(variant, q)) + OVERHEAD).cast("long")


def scalar_bits(dims: Column, b: Column) -> Column:
    return (dims * b + OVERHEAD).cast("long")


def raw_bits(dims: Column) -> Column:
    return (16 * dims).cast("long")


def fp8_bits(dims: Column, block: int = 64) -> Column:
    return (8 * dims + F.floor(dims / block) * 16).cast("long")


def codebook_bits(n: Column) -> Column:
    return F.when(n <= 1, 1).otherwise(F.ceil(F.log2(n))).cast("long")


def compression(raw: Column, coded: Column) -> Column:
    return raw / coded


def saved(raw: Column, coded: Column) -> Column:
    return 1 - coded / raw


def saving_percent(base: Column, coded: Column) -> Column:
    return 100 * (1 - coded / base)


def ms_per_million(seconds: Column, layers: Column, tokens: Column, heads: Column) -> Column:
    return seconds * 1e9 / (layers * tokens * heads)


def byte_label(n: Column) -> Column:
    """GiB with two decimals from one GiB on, else MiB without."""
    return F.when(n >= 1 << 30, F.format_string("%.2f GiB", n / float(1 << 30))).otherwise(F.format_string("%.0f MiB", n / float(1 << 20)))


def parameter_grid(spark: SparkSession, variants: dict[str, list[int]], dims: list[int]) -> DataFrame:
    """(variant, d, q) for every combination: a table to join vectors or reports with."""
    rows = [(v, d, q) for v, qs in variants.items() for d in dims for q in qs]
    return spark.createDataFrame(rows, "variant string, d int, q int")


def bit_table(grid: DataFrame) -> DataFrame:
    """(variant, d, q, bits, raw, ratio, saved) for lattice, scalar ("tq"), "fp8" and "bf16" rows."""
    lattice = lattice_bits(F.col("variant"), F.col("d"), F.col("q"))
    bits = F.when(F.col("variant").isin("d4", "e8"), lattice).when(F.col("variant") == "tq", scalar_bits(F.col("d"), F.col("q"))).when(F.col("variant") == "fp8", fp8_bits(F.col("d"))).otherwise(raw_bits(F.col("d")))
    out = grid.withColumn("bits", bits).withColumn("raw", raw_bits(F.col("d")))
    return out.withColumn("ratio", compression(F.col("raw"), F.col("bits"))).withColumn("saved", saved(F.col("raw"), F.col("bits")))


def iso_bit(qs: DataFrame, most: int = 499) -> DataFrame:
    """(q, q_e8): for each D4 range, the largest E8 range whose eight coordinates cost no more than two D4 blocks.

    The cost rises with the range, so a filter and a maximum find the end of the prefix that fits."""
    spark = qs.sparkSession
    tried = spark.range(1, most + 1).select(F.col("id").cast("int").alias("p"), F.ceil(8 * F.log2(2 * F.col("id") + 1)).alias("cost"))
    limit = qs.withColumn("room", 2 * F.ceil(4 * F.log2(2 * F.col("q") + 1) - 1))
    return limit.join(F.broadcast(tried), F.col("cost") <= F.col("room"), "left").groupBy("q").agg(F.max("p").alias("q_e8"))


def context_storage(layers: DataFrame, k_bits: Column, v_bits: Column, tokens: int = CONTEXT) -> DataFrame:
    """(baseline_bytes, coded_bytes, ratio) of a table (layer_id, d, heads, coded): other layers stay at 16 bits.

    Bits are cut to whole bytes for each vector, K and V apart."""
    plain = F.floor(raw_bits(F.col("d")) / 8) * 2
    coded = F.floor(k_bits / 8) + F.floor(v_bits / 8)
    vectors = F.col("heads").cast("long") * tokens
    out = layers.agg(F.sum(plain * vectors).alias("baseline_bytes"), F.sum(F.when(F.col("coded"), coded).otherwise(plain) * vectors).alias("coded_bytes"))
    return out.withColumn("ratio", F.col("baseline_bytes") / F.col("coded_bytes"))


def weighted_bits(layers: DataFrame, bits: Column, weight: Column) -> DataFrame:
    """(bits): the mean over layers."""
    return layers.agg((F.sum(bits * weight) / F.sum(weight)).alias("bits"))


def host_lattice_bits(variant: str, dims: int, q: int) -> int:
    """The same number on the driver, for labels and checks of parameters."""
    size, lost = {"d4": (4, 1), "e8": (8, 0)}[variant]
    return dims // size * math.ceil(size * math.log2(2 * q + 1) - lost) + OVERHEAD
