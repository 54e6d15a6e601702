"""Block pooling, normalisation and rotary positions over sequences of vectors.

Blocks are keys (position divided by the ratio), so pooling is a grouped aggregation with partial sums; a sequence of
any length spreads over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforge.functions.arrays import as_doubles, divided, let, squared_norm
from vecforge.functions.floats import e8m0
from vecforge.operators.codec import fp8_roundtrip


@dataclass(frozen=True)
class Shape:
    """Sizes of the three streams. Fixed values of the modelled architecture."""

    hidden: int = 4096
    head: int = 512
    rope: int = 64
    eps: float = 1e-6
    theta_main: float = 10_000.0
    theta_pooled: float = 160_000.0
    trained: int = 65_536
    stretch: float = 16.0
    turns: tuple[int, int] = (32, 1)


def check_length(n: int, ratio: int) -> None:
    if n < ratio:
        raise ValueError(f"a sequence of {n} is shorter than one block of {ratio}")


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, which of them there are) of an array column as rows of ``width``; what is null or missing is 0."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    inside, out, there = np.arange(width) < n[:, None], np.zeros((len(n), width)), np.zeros((len(n), width), bool)
    out[inside], there[inside] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
    return out, there


def _arrays(values: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    flat = pa.array(values.reshape(-1), mask=None if there is None else ~there.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


#: Sums of a block by coordinate: positions of its own, largest score, exponentials, values times exponentials.
_SUMS = ("own", "m", "e", "ve")
#: Numbers of one kind that are summed up at a time.
_CELLS = 1 << 18


def _codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values, nulls among them."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Batches in pieces of about ``_CELLS`` numbers, with the width of the longest array in ``column``."""
    for b in batches:
        width = max(1, pc.max(pc.list_value_length(b.column(column))).as_py() or 0)
        for at in range(0, b.num_rows, step := max(1, _CELLS // width)):
            yield b.slice(at, step), width


def _summed(keys: list[pa.Array], names: list[str], own: np.ndarray, m: np.ndarray, scored: np.ndarray, e: np.ndarray, ve: np.ndarray, valued: np.ndarray) -> pa.RecordBatch:
    """One row for each run of equal keys; sums are relative to the largest score, so exponentials stay in range.

    A score that is null leaves its coordinate out, a value that is null adds nothing; a sum of nothing is null."""
    codes = [_codes(k) for k in keys]
    begin = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in codes])]))
    valued = valued & scored
    with np.errstate(invalid="ignore", over="ignore"):
        top = np.maximum.reduceat(np.where(scored, m, -np.inf), begin)
        share = np.exp(m - np.repeat(top, np.diff([*begin, len(m)]), axis=0))
        own, e, ve = (np.add.reduceat(x, begin) for x in (own, np.where(scored, e * share, 0.0), np.where(valued, ve * share, 0.0)))
    some, found = np.logical_or.reduceat(scored, begin), np.logical_or.reduceat(valued, begin)
    return pa.RecordBatch.from_arrays([*[k.take(pa.array(begin)) for k in keys], _arrays(own), _arrays(top, some), _arrays(e), _arrays(ve, found)], names=names)


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, own, s, v) to sums: rows of one block that come near each other become one before the shuffle."""
    for b, width in _pieces(batches, "v"):
        b = b.take(pa.array(np.lexsort([_codes(k) for k in b.columns[:-3]])))
        (s, scored), (v, valued) = _matrix(b.column("s"), width), _matrix(b.column("v"), width)
        own = np.repeat(b.column("own").to_numpy()[:, None].astype(float), width, axis=1)
        yield _summed(b.columns[:-3], [*b.schema.names[:-3], *_SUMS], own, s, scored, np.ones_like(s), v, valued)


def _fold_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums in the order of their keys: the last block of a piece goes on in the next one."""
    held = None
    for b, width in _pieces(batches, "own"):
        b = b if held is None else pa.concat_batches([held, b])
        width = max(width, len(b.column("own")[0]))
        (own, _), (m, scored), (e, _), (ve, valued) = (_matrix(b.column(n), width) for n in _SUMS)
        b = _summed(b.columns[:-4], b.schema.names, own, m, scored, e, ve, valued)
        held = b.slice(b.num_rows - 1)
        if b.num_rows > 1:
            yield b.slice(0, b.num_rows - 1)
    if held is not None:
        yield held


def _pool(rows: DataFrame, keys: Sequence[str], ratio: int) -> DataFrame:
    """Softmax of the scores within each (keys, block) and coordinate, times the values.

    rows: (keys, block, own, s array, v array), arrays of one length; a block with fewer than ``ratio`` positions of its
    own, as at the end of a sequence, is dropped. Rows are summed up in their batches, then by block: one scan, one
    shuffle of sums, no row for a coordinate and no task that holds a block."""
    each = [*keys, "block"]
    whole = rows.where("block is not null and size(v) > 0")
    fields = ", ".join(f"`{n}` {t}" for n, t in whole.select(*each).dtypes) + "".join(f", `{n}` array<double>" for n in _SUMS)
    sums = whole.mapInArrow(_fold_rows, fields).repartition(*each).sortWithinPartitions(*each).mapInArrow(_fold_sums, fields)
    cells = F.filter(F.arrays_zip(*_SUMS), lambda c: c["own"] >= ratio)
    return sums.select(*each, F.transform(cells, lambda c: c["ve"] / c["e"]).alias("pooled")).where("size(pooled) > 0")


def _even(v: Column, s: Column) -> Column:
    """STRUCT<v, s> of doubles, the shorter array filled up with nulls; null if one of them is."""
    pairs = F.arrays_zip(as_doubles(v).alias("v"), as_doubles(s).alias("s"))
    return F.when(F.size(v) == F.size(s), F.struct(as_doubles(v).alias("v"), as_doubles(s).alias("s"))).otherwise(let(pairs, lambda p: F.struct(p["v"].alias("v"), p["s"].alias("s"))))


def with_position_embedding(df: DataFrame, table: DataFrame, ratio: int, score: str = "score", pos: str = "pos") -> DataFrame:
    """Adds the embedding of the place in the block, from a table (place, ape) of ``ratio`` rows."""
    own = df.withColumn("place", F.col(pos) % ratio).join(F.broadcast(table), "place")
    return own.withColumn(score, F.zip_with(as_doubles(F.col(score)), as_doubles(F.col("ape")), lambda a, b: a + b)).drop("place", "ape")


def pool(df: DataFrame, ratio: int, keys: Sequence[str] = (), value: str = "value", score: str = "score", pos: str = "pos") -> DataFrame:
    """(keys, block, pooled): blocks of ``ratio`` positions, over sequences of any lengths; positions run from 0."""
    each = df.select(*keys, F.floor(F.col(pos) / ratio).alias("block"), F.lit(1).alias("own"), _even(F.col(value), F.col(score)).alias("c"))
    return _pool(each.select(*keys, "block", "own", "c.s", "c.v"), keys, ratio)


def pool_overlapping(df: DataFrame, ratio: int, dims: int, keys: Sequence[str] = (), value: str = "value", score: str = "score", pos: str = "pos") -> DataFrame:
    """(keys, block, pooled) over windows of two blocks: the low half of the block before, the high half of its own.

    Vectors are ``2 * dims`` wide. Each position gives its high half to its block and its low half to the next;
    the first block has no block before it."""
    block = F.floor(F.col(pos) / ratio)

    def half(b: Column, first: int, own: int) -> Column:
        return F.struct(b.alias("block"), F.slice(F.col(value), first, dims).alias("v"), F.slice(F.col(score), first, dims).alias("s"), F.lit(own).alias("own"))

    halves = df.select(*keys, F.explode(F.array(half(block, dims + 1, 1), half(block + 1, 1, 0))).alias("h"))
    each = halves.select(*keys, "h.block", "h.own", _even(F.col("h.v"), F.col("h.s")).alias("c"))
    return _pool(each.select(*keys, "block", "own", "c.s", "c.v"), keys, ratio)


def project(df: DataFrame, weight: np.ndarray, vec_col: str, name: str) -> DataFrame:
    """x W^T with a matrix that is fixed by the model, sent once to each task; whole Arrow batches at a time."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    at = df.columns.index(vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(at).to_pylist(), float).reshape(b.num_rows, weight.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(x @ weight.T), pa.list_(pa.float64()))], names=[*b.schema.names, name])

    return df.mapInArrow(run, f"{schema}, `{name}` array<double>")


def projection_matrix(rows: int, columns: int, seed: int) -> np.ndarray:
    """Fixed-seed Gaussian weights of variance one over the input width."""
    return np.random.default_rng(seed).normal(size=(rows, columns)) / math.sqrt(columns)


def rms_norm(vec: Column, dims: int, weight: Column | None = None, eps: float = 1e-6) -> Column:
    out = let(as_doubles(vec), lambda x: let(F.sqrt(squared_norm(x) / dims + eps), lambda size: divided(x, size)))
    return out if weight is None else F.zip_with(out, weight, lambda a, b: a * b)


def frequencies(dims: int, base: float, length: int = 0, trained: int = 0, stretch: float = 1.0, turns: tuple[int, int] = (32, 1)) -> list[float]:
    """Rotary frequencies of ``dims / 2`` pairs. For sequences longer than the trained length, pairs that make few turns
    over it are slowed by ``stretch``: none up to the pair of ``turns[0]`` turns, all from that of ``turns[1]`` on,
    evenly more between. A trained length of 0 slows none."""
    pairs = np.arange(dims // 2)
    # one power at a time: those of whole arrays can be a last digit off, and far positions multiply it
    plain = np.array([base ** (-2.0 * i / dims) for i in range(dims // 2)])
    if length <= trained or not trained:
        return plain.tolist()
    fast, slow = (dims / 2 * math.log(trained / (2 * math.pi * t), base) for t in turns)
    begin, end = max(math.floor(fast), 0), min(math.ceil(slow), dims - 1)
    slowed = np.interp(pairs, [begin, end], [0.0, 1.0]) if end > begin else (pairs > begin) * 1.0
    return (plain * (1 - slowed * (1 - 1 / stretch))).tolist()


def rotary(vec: Column, pos: Column, freqs: Sequence[float], dims: int, inverse: bool = False) -> Column:
    """Turns the neighbouring pairs of the last ``2 * len(freqs)`` coordinates by position x frequency."""
    tail = 2 * len(freqs)
    first = dims - tail
    sign = -1.0 if inverse else 1.0

    def turned(x: Column) -> Column:
        def pair(f: Column, i: Column) -> Column:
            at = (i * 2 + first).cast("int")
            return let(pos * f, lambda angle: let(F.struct(F.get(x, at).alias("a"), F.get(x, at + 1).alias("b"), F.cos(angle).alias("c"), (F.sin(angle) * sign).alias("s")), lambda p: F.array(p["a"] * p["c"] - p["b"] * p["s"], p["a"] * p["s"] + p["b"] * p["c"])))

        turns = F.flatten(F.transform(F.lit([float(f) for f in freqs]), pair))
        return F.concat(F.slice(x, 1, first), turns) if first else turns

    return let(as_doubles(vec), turned)


def pooled_positions(block: Column, ratio: int) -> Column:
    return block * ratio


def main_stream(df: DataFrame, weight: np.ndarray, shape: Shape, vec_col: str = "hidden", pos: str = "pos") -> DataFrame:
    """Project, normalise, turn, and round all but the turned coordinates to FP8: column ``kv``."""
    out = project(df, weight, vec_col, "kv").withColumn("kv", rms_norm(F.col("kv"), shape.head, eps=shape.eps))
    out = out.withColumn("kv", rotary(F.col("kv"), F.col(pos), frequencies(shape.rope, shape.theta_main), shape.head))
    return out.withColumn("kv", fp8_roundtrip(F.col("kv"), shape.head, keep_last=shape.rope))


def pooled_stream(df: DataFrame, values: np.ndarray, gates: np.ndarray, ape: DataFrame, ratio: int, n: int, shape: Shape, overlap: bool, vec_col: str = "hidden", pos: str = "pos") -> DataFrame:
    """(block, kv): gated pooling, then as the main stream at the positions of the blocks."""
    check_length(n, ratio)
    own = project(project(df, values, vec_col, "value"), gates, vec_col, "score")
    own = with_position_embedding(own.select(pos, "value", "score"), ape, ratio, pos=pos)
    out = pool_overlapping(own, ratio, shape.head, pos=pos) if overlap else pool(own, ratio, pos=pos)
    freqs = frequencies(shape.rope, shape.theta_pooled, n, shape.trained, shape.stretch, shape.turns)
    out = out.withColumn("kv", rms_norm(F.col("pooled"), shape.head, eps=shape.eps))
    out = out.withColumn("kv", rotary(F.col("kv"), pooled_positions(F.col("block"), ratio), freqs, shape.head))
    return out.select("block", fp8_roundtrip(F.col("kv"), shape.head, keep_last=shape.rope).alias("kv"))


def streams(df: DataFrame, n: int, shape: Shape, seed: int = 0) -> DataFrame:
    """(stream, pos, kv): the sliding, the overlapping ratio-4 and the ratio-128 stream with fixed-seed weights."""
    if n < 128 or n % 128:
        raise ValueError("the sequence must be a multiple of 128")
    spark = df.sparkSession
    rng = np.random.default_rng(seed)

    def ape(ratio: int, width: int) -> DataFrame:
        return spark.createDataFrame([(i, r) for i, r in enumerate((rng.normal(size=(ratio, width)) * 0.02).tolist())], "place int, ape array<double>")

    w = [projection_matrix(k * shape.head, shape.hidden, seed + i) for i, k in enumerate((1, 2, 2, 1, 1))]
    sliding = main_stream(df, w[0], shape).select(F.lit("sliding").alias("stream"), "pos", "kv")
    ratio4 = pooled_stream(df, w[1], w[2], ape(4, 2 * shape.head), 4, n, shape, True).select(F.lit("pool4").alias("stream"), F.col("block").alias("pos"), "kv")
    ratio128 = pooled_stream(df, w[3], w[4], ape(128, shape.head), 128, n, shape, False).select(F.lit("pool128").alias("stream"), F.col("block").alias("pos"), "kv")
    return sliding.union(ratio4).union(ratio128)


def dequantised_tiles(weights: DataFrame, scales: DataFrame, tile: int = 128) -> DataFrame:
    """(name, i, j, w) of narrow weights times the power-of-two scale of their tile.

    weights: (name, i, j, w); scales: (name, ti, tj, byte)."""
    own = weights.withColumn("ti", F.floor(F.col("i") / tile)).withColumn("tj", F.floor(F.col("j") / tile))
    return own.join(scales, ["name", "ti", "tj"]).select("name", "i", "j", (F.col("w") * e8m0(F.col("byte"))).alias("w"))


def paired_tensors(names: DataFrame, prefix: str) -> DataFrame:
    """(base, weight, scale): each weight under the prefix with the scale of the same base name, if there is one."""
    own = names.where(F.col("name").startswith(prefix))
    w = own.where(F.col("name").endswith(".weight")).select(F.regexp_replace("name", r"\.weight$", "").alias("base"), F.col("name").alias("weight"))
    s = own.where(F.col("name").endswith(".scale")).select(F.regexp_replace("name", r"\.scale$", "").alias("base"), F.col("name").alias("scale"))
    return w.join(s, "base", "left")
