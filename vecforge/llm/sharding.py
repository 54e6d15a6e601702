"""Sharding along a Hilbert curve.

Several metadata columns are quantised at their quantiles (approximate for numbers; strings are compared whole, at
cuts taken from the counts of their distinct values), the cells are numbered along a Hilbert curve, rows are sorted by that number, and the order is cut into runs of equal row counts. Rows that lie close in
all dimensions share a shard, so a reader that filters on any of them skips most files.

Law ``rows``: shard sizes differ by one row at most, whatever the skew: a cell that holds a third of all rows is
cut by id like any other run.

Defined results: a null value sorts as the lowest cell; a null text has 0 bytes and the checksum of no bytes; rows
with a null id are left out; repeated rows each get a slot; ties on the curve go by id, then checksum; an empty
table gives an empty result; other columns are ignored unless asked for with ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecforge.llm.common import n_partitions, stored, with_position

BITS = 6
PER_ROW = 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of each column of ``cells`` (dimensions x rows, values below 2**bits)."""
    x = [c.astype(np.int64).copy() for c in cells]
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations and reflections from the top bit down
        q = np.int64(1 << level)
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.int64(1 << level)
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
    x = [v ^ flip for v in x]
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> level) & 1)
    return out


def string_cuts(df: DataFrame, name: str, parts: int) -> list[str]:
    """At most ``parts - 1`` values that cut the rows, in the order of the column, into runs of about equal size.

    Distinct values are range-partitioned with their counts; one total for each partition reaches the driver."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(n_partitions(df.sparkSession), "v").withColumn("part", F.spark_partition_id())
    kept = stored(ranged, "string-counts")
    sums = sorted((r[0], r[1]) for r in kept.groupBy("part").agg(F.sum("n")).collect())
    total = sum(n for _, n in sums)
    if not total:
        return []
    starts = df.sparkSession.createDataFrame(list(zip([p for p, _ in sums], accumulate([n for _, n in sums], initial=0), strict=False)), "part int, start long")
    below = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("v")) - F.col("n")
    at = kept.join(F.broadcast(starts), "part").select("v", "n", below.alias("below"))
    cell = lambda c: F.floor(c * parts / total)
    cuts = at.where((F.col("below") > 0) & (cell(F.col("below")) > cell(F.col("below") - 1)) | (cell(F.col("below") + F.col("n") - 1) > cell(F.col("below"))))
    return sorted(r[0] for r in cuts.select("v").collect())


def cells(df: DataFrame, name: str, parts: int) -> Column:
    """The cell of each row, from 0 for null to ``parts`` less one."""
    value: Column = F.col(name)
    if dict(df.dtypes)[name] == "string":
        edges: list = string_cuts(df, name, parts)
    else:
        value = value.cast("double")
        found = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000)).first()[0]
        edges = sorted(set(found or []))
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value)) if edges else F.lit(0)


def on_curve(df: DataFrame, dims: Sequence[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """``df`` with the position of each row on the curve through the quantised ``dims``."""

    @F.pandas_udf("long")
    def place(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([frame[c].to_numpy() for c in frame]), bits))

    return df.withColumn(name, place(F.struct(*[cells(df, d, 2**bits).alias(f"d{i}") for i, d in enumerate(dims)])))


def hilbert_shards(docs: DataFrame, shards: int, dims: Sequence[str] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, size, text_crc32, shard, slot) and the columns to ``keep`` for each row with an id."""
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    own = docs.where(F.col(id_col).isNotNull())
    placed = on_curve(own, dims, name="_curve").select(F.col(id_col).alias("id"), (F.octet_length(raw).cast("long") + PER_ROW).alias("size"), F.crc32(raw).alias("text_crc32"), F.col("_curve").alias("curve"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    ranked = with_position(placed, ["curve", "id", "text_crc32"])
    n = F.lit(ranked.count())
    shard = F.expr("position") * shards
    out = ranked.withColumn("shard", F.floor(shard / n).cast("int"))
    return out.withColumn("slot", F.col("position") - F.ceil(F.col("shard").cast("long") * n / shards)).select("id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
