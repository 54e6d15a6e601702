"""The lattice codecs as array operations on Arrow batches: for sweeps, where one rotation serves many ranges.

A task holds one Arrow batch at a time; nothing is shuffled before the sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = np.finfo(np.float32).eps


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, by rounds of sums and differences."""
    n, dims = x.shape
    step = 1
    while step < dims:
        pairs = x.reshape(n, -1, 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, dims)
        step *= 2
    return x / np.sqrt(dims)


def _even(blocks: np.ndarray) -> np.ndarray:
    point = np.rint(blocks)
    off = blocks - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    at = np.abs(off[odd]).argmax(axis=1)
    point[odd, at] += np.where(off[odd, at] >= 0, 1.0, -1.0)
    return point


def nearest(variant: str, scaled: np.ndarray) -> np.ndarray:
    if variant == "zn":
        return np.rint(scaled)
    size = {"d4": 4, "e8": 8}[variant]
    blocks = scaled.reshape(-1, size)
    whole = _even(blocks)
    if variant == "e8":
        half = _even(blocks - 0.5) + 0.5
        closer = ((blocks - whole) ** 2).sum(axis=1) <= ((blocks - half) ** 2).sum(axis=1)
        whole = np.where(closer[:, None], whole, half)
    return whole.reshape(scaled.shape)


def roundtrips(x: np.ndarray, settings: Sequence[tuple[str, int]]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(variant, q, decoded) for each setting, from one rotation."""
    norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)
    y = hadamard(x / norm)
    top = np.maximum(np.abs(y).max(axis=1, keepdims=True), EPS).astype(np.float16).astype(float)
    stored = norm.astype(np.float16).astype(float)
    for variant, q in settings:
        scale = top / q
        yield variant, q, hadamard(np.clip(nearest(variant, y / scale), -q, q) * scale) * stored


def sweep(df: DataFrame, settings: Sequence[tuple[str, int]], vec_col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, variant, q, rel_mse, cos_mean, n) of every setting, from sums of each batch."""
    kinds = dict(df.dtypes)
    fields = "".join(f"`{c}` {kinds[c]}, " for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(len(by)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            n2 = (x * x).sum(axis=1)
            for variant, q, y in roundtrips(x, settings):
                error = ((x - y) ** 2).sum(axis=1)
                cos = (x * y).sum(axis=1) / (np.maximum(np.sqrt(n2), 1e-12) * np.maximum(np.linalg.norm(y, axis=1), 1e-12))
                extra = [pa.array([variant] * len(x)), pa.array(np.full(len(x), q, np.int32)), *map(pa.array, (error, n2, cos))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], *extra], names=[*by, "variant", "q", "error", "n2", "cos"])

    rows = df.select(*by, vec_col).mapInArrow(run, f"{fields}variant string, q int, error double, n2 double, cos double")
    return rows.groupBy(*by, "variant", "q").agg((F.sum("error") / F.greatest(F.sum("n2"), F.lit(1e-12))).alias("rel_mse"), F.avg("cos").alias("cos_mean"), F.count("*").alias("n"))
