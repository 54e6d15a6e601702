"""Binary codes by iterative quantisation: principal axes, then a learned rotation that balances the signs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh128_digest

from vecforge.llm.common import record_batch

#: About so many vectors, a hash sample, fit the rotation; every vector is indexed.
FIT_ROWS = 20_000
ITERATIONS = 30


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, digest, vec) of each row with an id: the vector as little-endian doubles and its 128-bit digest, both null
    if it is null, empty, zero, or holds a null or non-finite component. Minus zero counts as zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw: list[bytes | None] = []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], "<f8") + 0.0 if v else np.zeros(0)
                raw.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield record_batch(id=b.column(0), digest=pa.array([None if r is None else xxh128_digest(r) for r in raw], pa.binary()), vec=pa.array(raw, pa.binary()))

    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null")
    return own.mapInArrow(run, "id long, digest binary, vec binary")


def matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest magnitude is divided out first, so that no square leaves a double's range."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0.0), np.finfo(float).tiny)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny)


def learn(x: np.ndarray, bits: int, seed: int, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection dims x bits): ``bits`` at most the dimensions; on principal axes, then rotated. Not ``centred``,
    the mean is zero, and the codes compare the angles of the vectors as they are."""
    mean = x.mean(axis=0) if centred else np.zeros(x.shape[1])
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, ::-1][:, :bits]
    z = z @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(ITERATIONS):
        u, _, vt = np.linalg.svd(np.where(z @ rotation >= 0, 1.0, -1.0).T @ z)
        rotation = (u @ vt).T
    return mean, axes @ rotation


def usual_length(vecs: DataFrame) -> int:
    """The most frequent number of components, the smaller on ties; 0 without vectors."""
    sizes = vecs.groupBy(F.octet_length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return 0 if sizes is None else sizes["n"] // 8


def sample(vecs: DataFrame) -> np.ndarray:
    """A hash sample of about ``FIT_ROWS`` of the rows (digest, vec)."""
    n = vecs.count()
    rows = vecs if n <= FIT_ROWS else vecs.where(F.pmod(F.xxhash64("digest", F.lit("itq")), F.lit(1_000_000)) < int(FIT_ROWS / n * 1_000_000))
    return matrix([r[0] for r in rows.orderBy("digest").select("vec").collect()])


def codes(x: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One code of up to 64 bits for each row of unit vectors."""
    mean, projection = table
    signs = (x - mean) @ projection >= 0
    return np.packbits(np.pad(signs, ((0, 0), (0, 64 - signs.shape[1]))), axis=1, bitorder="little").view("<u8").ravel()
