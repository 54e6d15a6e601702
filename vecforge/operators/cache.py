"""The write path of a coded key/value store as table transforms: boundary layers, capture, replace, counters."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforge.functions.arrays import as_doubles
from vecforge.operators.codec import Codec


def boundary(layer: Column, n_layers: int, k: int) -> Column:
    """The first and last ``k`` layers; for large ``k`` both ends overlap and cover all."""
    return (layer < k) | (layer >= n_layers - k)


def capped_boundary(layer: Column, n_layers: int, k: int) -> Column:
    """As ``boundary``, with ``k`` at most half the layers, so that an odd middle layer stays inside."""
    return boundary(layer, n_layers, min(k, n_layers // 2))


def problems(dims: int, variant: str) -> list[str]:
    """Why a head size does not fit a codec; empty if it does."""
    size = {"d4": 4, "e8": 8}[variant]
    out = []
    if dims < 1 or dims & (dims - 1):
        out.append(f"head size {dims} is no power of two")
    if dims % size:
        out.append(f"head size {dims} is no multiple of {size}")
    return out


def layer_codecs(n_layers: int, k: int, dims: int, variant: str, q: int, strict: bool = True) -> dict[int, Codec | None]:
    """A codec for each layer, None for boundary layers; an unfit head size is an error, or a warning and no codec."""
    if found := problems(dims, variant):
        if strict:
            raise ValueError("; ".join(found))
        warnings.warn("; ".join(found), stacklevel=2)
        return dict.fromkeys(range(n_layers))
    return {i: None if i < k or i >= n_layers - k else Codec(variant, dims, q) for i in range(n_layers)}


def write(df: DataFrame, codec: Codec | None, n_layers: int, k: int, vec_col: str = "vec", layer_col: str = "layer_id") -> DataFrame:
    """Rows with the vector as stored and ``fired``: boundary layers, or all without a codec, pass unchanged.

    Works alike on batch tables and streams: it is a projection."""
    if codec is None:
        return df.withColumn("fired", F.lit(False))
    passes = boundary(F.col(layer_col), n_layers, k)
    coded = F.transform(codec.roundtrip(F.col(vec_col)), lambda x: x.cast("float"))
    return df.withColumn("fired", ~passes).withColumn(vec_col, F.when(passes, F.transform(F.col(vec_col), lambda x: x.cast("float"))).otherwise(coded))


def counters(df: DataFrame, layer_col: str = "layer_id") -> DataFrame:
    """(layer_id, fires, skips)."""
    return df.groupBy(layer_col).agg(F.sum(F.col("fired").cast("long")).alias("fires"), F.sum((~F.col("fired")).cast("long")).alias("skips"))


def lengths(df: DataFrame, layer_col: str = "layer_id", position: str = "pos") -> DataFrame:
    """(layer_id, length): positions that each layer holds."""
    return df.groupBy(layer_col).agg(F.countDistinct(position).alias("length"))


def replace(live: DataFrame, stored: DataFrame, keys: Sequence[str] = ("layer_id",), row: Sequence[str] = ("token_idx",), vec_col: str = "vec") -> DataFrame:
    """Live rows with the stored vector where a layer is stored with the same number of tokens.

    Adds ``status``: replaced, mismatch (stored with another number), missing (not stored); the last two pass."""
    n_live = live.groupBy(*keys).agg(F.count("*").alias("_n_live"))
    n_stored = stored.groupBy(*keys).agg(F.count("*").alias("_n_stored"))
    status = F.when(F.col("_n_stored").isNull(), "missing").when(F.col("_n_live") == F.col("_n_stored"), "replaced").otherwise("mismatch")
    layers = n_live.join(n_stored, list(keys), "left").select(*keys, status.alias("status"))
    other = stored.select(*keys, *row, F.col(vec_col).alias("_stored"))
    out = live.join(layers, list(keys)).join(other, [*keys, *row], "left")
    return out.withColumn(vec_col, F.when(F.col("status") == "replaced", F.col("_stored")).otherwise(F.col(vec_col))).drop("_stored")


def replace_counts(replaced: DataFrame, layer_col: str = "layer_id") -> DataFrame:
    """(status, layers, n_rows)."""
    return replaced.groupBy("status").agg(F.countDistinct(layer_col).alias("layers"), F.count("*").alias("n_rows"))


def inforward(df: DataFrame, codecs: Mapping[int, Codec], skipped: DataFrame, layer_col: str = "layer_id", vec_col: str = "vec") -> DataFrame:
    """Codec on every row but those of skipped layers; a layer's vector length without a codec is an error."""
    from vecforge.operators.codec import dispatched_roundtrip

    marked = df.join(F.broadcast(skipped.select(layer_col).distinct().withColumn("_skip", F.lit(True))), layer_col, "left")
    skip = F.col("_skip").isNotNull()
    return marked.withColumn("fired", ~skip).withColumn(vec_col, F.when(skip, as_doubles(F.col(vec_col))).otherwise(dispatched_roundtrip(F.col(vec_col), codecs))).drop("_skip")


def effective_boundary(layers: DataFrame, captured: DataFrame, n_layers: int, k: int, layer_col: str = "layer_id") -> DataFrame:
    """(layer_id): boundary layers and those never captured."""
    ends = layers.where(capped_boundary(F.col(layer_col), n_layers, k)).select(layer_col)
    return ends.union(layers.join(captured, layer_col, "left_anti").select(layer_col)).distinct()


def guard(counts: DataFrame, expected: Column) -> DataFrame:
    """``fatal`` holds a message where a layer fired less often than expected, else null."""
    message = F.concat(F.lit("fired "), F.col("fires").cast("string"), F.lit(" of "), expected.cast("string"))
    return counts.withColumn("fatal", F.when(F.col("fires") < expected, message))


def without_shared(df: DataFrame, shared: str = "kv_shared") -> DataFrame:
    """Layers that reuse another layer's vectors are not captured."""
    return df.where(~F.col(shared))
