"""Spherical codebooks: unit codewords, the nearest by absolute inner product.

A codebook is a fixed table of at most ``MOST`` numbers, set by its parameters and not by the data, so every task can
hold it: vectors are never joined with codewords row by row. Structured codebooks are also available as DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.functions.arrays import as_doubles, norm, scaled

#: Numbers in a codebook; a larger one is refused rather than sent to the tasks.
MOST = 1 << 24
CHUNK = 1 << 22


@dataclass(frozen=True)
class Codebook:
    name: str
    codewords: np.ndarray  # one unit row for each codeword

    def __post_init__(self) -> None:
        if self.codewords.ndim != 2:
            raise ValueError("codewords must be a matrix")
        if self.codewords.size > MOST:
            raise ValueError(f"a codebook holds at most {MOST} numbers")

    @property
    def bits(self) -> int:
        return max(1, math.ceil(math.log2(len(self.codewords)))) if len(self.codewords) > 1 else 1

    def table(self, spark: SparkSession) -> DataFrame:
        """(seg_id, codeword)."""
        return spark.createDataFrame([(i, c) for i, c in enumerate(self.codewords.tolist())], "seg_id int, codeword array<double>")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(np.float32).eps)


def random_codebook(n: int, dims: int, seed: int = 0xC0DE) -> Codebook:
    return Codebook(f"random-{n}", _unit(np.random.default_rng(seed).normal(size=(n, dims))))


def hadamard_rows(n: int, dims: int) -> Codebook:
    """The first ``n`` rows of the Hadamard matrix."""
    if dims & (dims - 1) or not 1 <= n <= dims:
        raise ValueError("needs a power of two and at most that many rows")
    i, j = np.arange(n)[:, None], np.arange(dims)[None, :]
    return Codebook(f"hadamard-{n}", np.where(np.bitwise_count(i & j) % 2 == 0, 1.0, -1.0) / math.sqrt(dims))


def hadamard_vertices(n: int, dims: int) -> Codebook:
    """All sign patterns of the first ``n`` coordinates; bit j of the number makes coordinate j negative."""
    if not 1 <= n <= min(dims, 20):
        raise ValueError("n must lie between 1 and the smaller of dims and 20")
    i, j = np.arange(1 << n)[:, None], np.arange(dims)[None, :]
    return Codebook(f"vertices-{n}", np.where((j < n) & ((i >> np.minimum(j, 62)) & 1 == 1), -1.0, 1.0) / math.sqrt(dims))


def planes(dims: int, angles: int = 16, scales: int = 1, seed: int = 0xDADA) -> Codebook:
    """Half circles in the planes of neighbouring axes, and in randomly turned planes with half as many angles each."""
    if dims % 2:
        raise ValueError("dims must be even")
    rng = np.random.default_rng(seed)
    parts = []
    for scale in range(scales):
        turn = np.eye(dims) if scale == 0 else np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        theta = np.arange(m := max(2, angles >> scale)) * (math.pi / m)
        a, b = turn[:, 0::2].T, turn[:, 1::2].T
        parts.append((np.cos(theta)[None, :, None] * a[:, None, :] + np.sin(theta)[None, :, None] * b[:, None, :]).reshape(-1, dims))
    return Codebook(f"planes-{angles}x{scales}", _unit(np.concatenate(parts)))


def encode(df: DataFrame, codebook: Codebook, vec_col: str) -> DataFrame:
    """``df`` with seg_id and t: the codeword of largest absolute inner product, the first on ties, and that product."""
    words = codebook.codewords
    rows = max(1, CHUNK // len(words))
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    at = df.columns.index(vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                x = np.array(part.column(at).to_pylist(), float).reshape(part.num_rows, words.shape[1])
                cosines = x @ words.T
                # equal magnitudes differ in the last bits only: rounding makes the first of them win
                best = np.abs(cosines.round(12)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.astype(np.int32)), pa.array(cosines[np.arange(len(x)), best])], names=[*part.schema.names, "seg_id", "t"])

    return df.mapInArrow(run, f"{schema}, seg_id int, t double")


def decode(df: DataFrame, codebook: Codebook, name: str = "decoded", factor: Column | None = None) -> DataFrame:
    """``df`` (with seg_id and t) and the vector t x codeword: a join with a table of fixed size."""
    words = F.broadcast(codebook.table(df.sparkSession))
    size = F.col("t") if factor is None else F.col("t") * factor
    return df.join(words, "seg_id").withColumn(name, scaled(F.col("codeword"), size)).drop("codeword")


def roundtrip(df: DataFrame, codebook: Codebook, vec_col: str, name: str = "decoded") -> DataFrame:
    """Encode the unit vector, decode, and restore the norm, which is kept whole."""
    x = as_doubles(F.col(vec_col))
    unit = df.withColumn("_norm", norm(x)).withColumn("_unit", F.transform(x, lambda v: v / F.col("_norm")))
    return decode(encode(unit, codebook, "_unit"), codebook, name, F.col("_norm")).drop("_unit", "_norm")
