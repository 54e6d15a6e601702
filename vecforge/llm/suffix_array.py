"""Suffix order by prefix tripling, as Spark sorts.

``suffix_order`` takes many strings of letters and gives each suffix a position. A round sorts triples and names each
by the number of smaller ones: first triples of letters, then of names that lie 1, 3, 9 places of what is known apart,
so that a round orders suffixes by three times as many letters. Suffixes with equal keys lie side by side, and
``adjacent`` compares neighbours.

Each step is one range-partitioned sort of narrow rows; what reaches the driver is one row of counts for each
partition. Strings are pieces of bounded length that the caller cuts; see ``substring_dedup``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforge.llm.common import n_partitions, record_batch, stored

#: The letter past the end of a string; letters are at least 0.
PAST = -1


def counts_below(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with n0 in place of the keys: for each row, how many rows have a smaller key."""
    spark = df.sparkSession
    rest = [n for n in df.columns if n not in keys]
    fields = ", ".join(f"{n} {t}" for n, t in df.dtypes if n in rest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, seen, last = 0, 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            new[0] = last is None or any(c[0] != v for c, v in zip(cols, last, strict=True))
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = np.where(begin >= 0, seen + begin, below)
            below, seen, last = int(out[-1]), seen + n, [c[-1] for c in cols]
            yield record_batch(**{name: b.column(name) for name in rest}, n0=out)

    ranged = df.repartitionByRange(n_partitions(spark), *keys).sortWithinPartitions(*keys)
    kept = stored(ranged.mapInArrow(count, f"{fields}, n0 long").withColumn("_part", F.spark_partition_id()), "suffix-sorted")
    sums = sorted((r[0], r[1]) for r in kept.groupBy("_part").count().collect())
    small = spark.createDataFrame(list(zip([p for p, _ in sums], accumulate([n for _, n in sums], initial=0), strict=False)), "_part int, _before long")
    return kept.join(F.broadcast(small), "_part").select(*rest, (F.col("n0") + F.col("_before")).alias("n0"))


def _triples(step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each suffix with its letters (or names) at 0, ``step`` and twice ``step`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("letters")
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at, ends = np.arange(len(flat)), np.repeat(np.cumsum(n), n)
            b_, c = (np.where(at + k < ends, flat[np.minimum(at + k, len(flat) - 1)], PAST) if len(flat) else flat for k in (step, 2 * step))
            yield record_batch(sid=np.repeat(b.column("sid").to_numpy(), n), j=(at - (ends - np.repeat(n, n))).astype(np.int32), a=flat, b=b_, c=c)

    return run


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One array for each sid, of rows that are sorted by it; a string may reach over batches."""
    held: list[pa.RecordBatch] = []

    def lists(sid: np.ndarray, n: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
        return record_batch(sid=sid[begins], letters=pa.ListArray.from_arrays(pa.array(np.append(begins, len(sid)), pa.int32()), pa.array(n)))

    for b in batches:
        sid = b.column("sid").to_numpy()
        if not len(sid):
            continue
        if sid[0] == sid[-1]:
            if held and held[-1].column("sid")[-1].as_py() != sid[0]:
                yield lists(*_joined(held))
                held = []
            held.append(b)
            continue
        cut = int(np.searchsorted(sid, sid[-1]))
        yield lists(*_joined([*held, b.slice(0, cut)]))
        held = [b.slice(cut)]
    if held:
        yield lists(*_joined(held))


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sid, n = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("sid", "n0"))
    return sid, n, np.concatenate([[0], np.flatnonzero(sid[1:] != sid[:-1]) + 1])


def suffix_order(strings: DataFrame, depth: int) -> DataFrame:
    """(sid, ranks): for each string (sid long, letters array<long>), the number of smaller suffixes by position; suffixes
    are compared by ``depth`` letters at least."""
    step, strings = 1, stored(strings.select("sid", "letters"), "suffix-strings")
    while True:
        rows = stored(strings.mapInArrow(_triples(step), "sid long, j int, a long, b long, c long"), "suffix-triples")
        named = counts_below(rows, ["a", "b", "c"])
        ordered = named.repartition("sid").sortWithinPartitions("sid", "j").select("sid", "n0")
        # stored, so that a task runs one Python worker and not two in a row
        strings = stored(ordered.mapInArrow(_arrays, "sid long, letters array<long>"), "suffix-names")
        step *= 3
        if step >= depth:
            return strings.withColumnRenamed("letters", "ranks")


def adjacent(suffixes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``suffixes`` without the keys and with ``repeated``: does a neighbour in their order have equal keys?

    Rows with equal keys share a range partition."""
    rest = [n for n in suffixes.columns if n not in keys]
    fields = ", ".join(f"{n} {t}" for n, t in suffixes.dtypes if n in rest)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carried = None, False
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.concat_batches([held, b])
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            same = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
            flag = np.concatenate([[carried], same]) | np.concatenate([same, [False]])
            held, carried = b.slice(b.num_rows - 1), bool(same[-1]) if len(same) else carried
            yield record_batch(**{n: b.column(n).slice(0, b.num_rows - 1) for n in rest}, repeated=flag[:-1])
        if held is not None:
            yield record_batch(**{n: held.column(n) for n in rest}, repeated=np.array([carried]))

    ranged = suffixes.repartitionByRange(n_partitions(suffixes.sparkSession), *keys).sortWithinPartitions(*keys)
    return ranged.mapInArrow(compare, f"{fields}, repeated boolean")
