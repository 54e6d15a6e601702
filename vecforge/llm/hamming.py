"""Joining binary codes at a small Hamming distance through shared index keys.

A caller gives the keys under which a code is indexed; equal keys meet in one shuffle and each meeting is verified on
the whole codes. A key with at most ``BLOCK`` codes is compared at once and gives a spanning forest of its links,
never all its pairs. Keys with more codes are counted beforehand and dealt out: their codes go into blocks by hash,
each (key, block) to a task of its own, a block becomes one row, and pairs of blocks are dealt out again by (key,
block, block). No task holds a hot key; comparing one takes the square of its blocks, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforge.llm.common import connected_components, discard, n_partitions, popcount, record_batch, sorted_runs, stored

BLOCK = 1024
#: Codes of a hot key in one row, about.
PACK = 4096
OUT = 1 << 15


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of a symmetric boolean matrix: each index that isn't the first of its component, and that first."""
    n = len(near)
    label = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label, n).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(n))
    return far, label[far]


def _within(x: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    if len(x) == 2:
        return (x[1:], x[:1]) if popcount(x[0] ^ x[1]) <= max_bits else (x[:0], x[:0])
    member, root = forest(popcount(x[:, None] ^ x[None, :]) <= max_bits)
    return x[member], x[root]


def components(codes: DataFrame, keys: Callable[[np.ndarray], list[np.ndarray]], max_bits: int) -> DataFrame:
    """(id, root) for the values of column ``code`` (long) that are linked with another; the smallest as signed number.

    keys: from codes (uint64) to index keys, array by array."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_codes = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_codes), 1 << 12):
                part = all_codes[at : at + (1 << 12)]
                own = keys(part)
                yield record_batch(key=np.concatenate(own).view(np.int64), id=np.tile(part, len(own)).view(np.int64))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []

        def found():
            u, v = (np.concatenate([*x, np.zeros(0, np.uint64)]).view(np.int64) for x in (us, vs))
            return record_batch(u=u, v=v)

        for _, _, cols in sorted_runs(batches, "key", BLOCK):
            x = cols["id"].view(np.uint64)
            if len(x) > 1:
                u, v = _within(x, max_bits)
                us.append(u)
                vs.append(v)
            if len(us) > OUT:
                yield found()
                us, vs = [], []
        yield found()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, c in sorted_runs(batches, "dealt", 1 << 62):
            yield record_batch(key=c["key"][:1], block=c["block"][:1], blocks=c["blocks"][:1], codes=pa.array([c["id"].tobytes()], pa.binary()))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, c in sorted_runs(batches, "dealt", 1 << 62):
            x = np.concatenate([np.frombuffer(r, np.uint64) for r in c["codes"]])
            parts = [x[i : i + BLOCK] for i in range(0, len(x), BLOCK)]
            for i, a in enumerate(parts):
                for b in parts[i:]:
                    u, v = _within(np.concatenate([a, b]) if b is not a else a, max_bits)
                    yield record_batch(u=u.view(np.int64), v=v.view(np.int64))

    n = n_partitions(codes.sparkSession)
    distinct = stored(codes.select("code").distinct(), "codes")
    indexed = distinct.repartition(n, "code").mapInArrow(index, "key long, id long")
    hot = stored(indexed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / PACK).cast("int").alias("blocks")), "hot-keys")
    crowded = not hot.isEmpty()
    cool = indexed.join(hot, "key", "left_anti") if crowded else indexed
    met = stored(cool.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long").distinct(), "hamming-links")
    if not crowded:
        return connected_components(met)
    rows = indexed.join(hot, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("dealt", F.xxhash64("key", "block"))
    packed = stored(rows.repartition(n, "dealt").sortWithinPartitions("dealt").mapInArrow(pack, "key long, block int, blocks int, codes binary"), "hot-blocks")
    each = packed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = each.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("dealt"), "codes")
    hot_links = stored(pairs.repartition(n, "dealt").sortWithinPartitions("dealt").mapInArrow(across, "u long, v long").distinct(), "hot-links")
    discard(packed)
    return connected_components(met.union(hot_links))
