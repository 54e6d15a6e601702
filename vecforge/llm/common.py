"""Helpers that the operators of this package share.

Tables that cut lineage go to the folder that the cluster names in ``spark.checkpoint.dir``. Without that setting, a
folder of our own serves a session that is one process, as in tests; on a cluster it is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Where the tables that ``stored`` gave are kept.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: While a table is written: its shuffle files go when it is done, and Python workers get small batches of long rows.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", master := spark.conf.get("spark.master", "")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master!r} share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"file://{_LOCAL[0]}"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    with _writing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empty stored tables that only finished, stored steps have read."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            table.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Number the rows from 0 in ``order``, without ever gathering them.

    Range partitions are sorted and stored with Spark's own (partition, row) ids; only the
    row count of each partition, one small row per partition, is summed up on the driver.
    """
    spark = df.sparkSession
    runs = stored(df.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_mid", 33)
    counts = sorted((r[0], r[1]) for r in runs.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    small = spark.createDataFrame(starts, "_part long, _start long")
    return runs.withColumn("_part", part).join(F.broadcast(small), "_part").withColumn(name, F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_mid")


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id that occurs in ``edges`` (u long, v long); root is the smallest id reachable.

    Alternates the large-star and small-star steps; each round is stored, so a lost executor costs one
    round at most. A hub is summed up before the shuffle, and its edges are an ordinary skewed join.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, last = state, now
        both = _neighbours(now)
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "edges")
        discard(last)
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct().groupBy("id").agg(F.min("root").alias("root"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def each_text(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """The same, one by one; few of them are held at a time."""
    for at in range(0, len(column), rows):
        yield from as_bytes(column.slice(at, rows))


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def sorted_runs(batches: Iterable[pa.RecordBatch], key: str, cap: int) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(key, block number, columns) of each run of equal keys in a sorted partition, at most ``cap`` rows at a time.

    A run longer than ``cap`` comes in numbered blocks, so that no task holds an unbounded group.
    """
    held: dict[str, list[np.ndarray]] = {}
    current, size, block = None, 0, 0
    for batch in batches:
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        keys = cols[key]
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if keys[a] != current:
                if size:
                    yield current, block, {n: np.concatenate(v) for n, v in held.items()}
                held, current, size, block = {n: [] for n in cols}, keys[a], 0, 0
            while a < b:
                take = min(b - a, cap - size)
                for n, v in cols.items():
                    held[n].append(v[a : a + take])
                size, a = size + take, a + take
                if size == cap:
                    yield current, block, {n: np.concatenate(v) for n, v in held.items()}
                    held, size, block = {n: [] for n in cols}, 0, block + 1
    if size:
        yield current, block, {n: np.concatenate(v) for n, v in held.items()}
