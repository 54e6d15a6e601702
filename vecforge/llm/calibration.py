"""Isotonic calibration from binned sums, so that only a fixed number of bins reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 2048


def pool_adjacent(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The rising step function closest to positive/weight (pool-adjacent-violators)."""
    blocks: list[list[float]] = []
    for i, (w, p) in enumerate(zip(weight.tolist(), positive.tolist(), strict=True)):
        blocks.append([w, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, p, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + p, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), p / w) for w, p, n in blocks]) if blocks else np.zeros(0)


def fit(scored: DataFrame, raw: str, label: str, low: float, high: float, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(bin centres, probability) from rows with a raw score and a 0/1 label; scores are clipped to [low, high].

    Each end is smoothed by one row of the other class, so no probability is exactly 0 or 1."""
    at: Column = F.least(F.greatest(F.floor((F.col(raw) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    sums = sorted(tuple(r) for r in scored.groupBy(at.alias("b")).agg(F.count("*"), F.sum(label)).collect())
    if not sums:
        return np.array([low, high]), np.array([0.5, 0.5])
    b, n, p = (np.array(v, float) for v in zip(*sums, strict=True))
    x = np.concatenate([[low], low + (b + 0.5) * (high - low) / bins, [high]])
    y = pool_adjacent(np.concatenate([[1.0], n, [1.0]]), np.concatenate([[0.5], p, [0.5]]))
    return x, y


def apply(curve: tuple[np.ndarray, np.ndarray], raw: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(raw, *curve), 0.0, 1.0)
