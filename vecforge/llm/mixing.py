"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: target share x budget / its own size. A uniform number hashed from
(seed, id) is put through the inverse of the Poisson distribution with that mean, the document is repeated that
many times, and all copies are sorted by a hash of (seed, id, copy): a global shuffle that anyone can repeat.

Only per-source sums are gathered, so a hot source is pre-aggregated before its shuffle; its documents are never
grouped. Sizes are UTF-8 bytes plus one, so that empty documents weigh something. A source's distribution is a table
of the counts within twelve standard deviations (and forty) of its rate, which grows with the square root of the rate;
the tables are broadcast if they hold at most ``MOST_BYTES``, else joined.

Defined results: a null text has size 1; a null source is a source of its own; rows with a null id are left out;
repeated rows get the same number of copies each; a source without weight gives no copies; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecforge.llm.common import n_partitions, stored, with_position

SEED = 1729
POWER = 0.5
#: Hex digits of the hash that make the uniform number: 52 bits, exact in a double.
DIGITS = 13
#: Larger tables of the sources' distributions are not sent to all tasks.
MOST_BYTES = 64 << 20


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) hashed from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def log_factorial(k: Column) -> Column:
    """ln k!: from a table up to 16, then by Stirling's series, whose error is below a double's there."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(17)])
    x = F.greatest(k, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return F.when(k <= 16, table[k.cast("int")]).otherwise(series)


def distributions(rated: DataFrame) -> DataFrame:
    """(source, rate, low, cdf): P(count <= low), P(count <= low + 1), ... until what is left is below the step of the
    uniform number; below ``low`` less is left still."""
    spread = 12 * F.sqrt("rate") + 40
    first, last = F.greatest(F.floor(F.col("rate") - spread), F.lit(0)), F.ceil(F.col("rate") + spread)
    each = rated.select("source", "rate", first.alias("low"), F.explode(F.sequence(first, last)).alias("k"))
    chance = F.exp(F.col("k") * F.log("rate") - F.col("rate") - log_factorial(F.col("k")))
    summed = each.withColumn("c", F.sum(chance).over(Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    pairs = F.sort_array(F.collect_list(F.struct("k", "c")))
    return summed.groupBy("source").agg(F.first("rate").alias("rate"), F.first("low").alias("low"), F.transform(pairs, lambda p: p["c"]).alias("cdf"))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, rate, low, cdf): without weights, the target share goes with the size to the power ``POWER``."""
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long") + 1
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(POWER)))
    else:
        pairs = [F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()]
        weighted = sizes.withColumn("weight", F.coalesce(*pairs, F.lit(0.0)))
    total = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    rate = F.col("weight") / F.col("all_weight") * (F.lit(float(epochs)) * F.col("all_size")) / F.col("size")
    return distributions(weighted.crossJoin(F.broadcast(total)).withColumn("rate", rate).where("rate > 0").select("source", "rate"))


def replicated(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, copies, copy, shuffle_key): each row as often as drawn; copy counts from 1.

    ``row`` is a struct of the columns to ``keep`` (all, if not given), so that no name can clash."""
    own = docs.where(F.col(id_col).isNotNull())
    table = stored(rates(own, weights, epochs, source_col, text_col).select(F.col("source").alias("_source"), "low", "cdf"), "rates")
    size = table.agg(F.sum(8 * F.size("cdf") + F.coalesce(F.octet_length("_source"), F.lit(0)) + 64)).first()[0]
    if (size or 0) <= MOST_BYTES:  # else an ordinary join, whose hot keys Spark splits
        table = F.broadcast(table)
    u = uniform(F.lit("count"), F.lit(str(seed)), F.col(id_col).cast("string"))
    whole = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    rows = own.select(whole.alias("row"), F.col(source_col).alias("_of"), u.alias("_u"), F.col(id_col).cast("string").alias("_id"))
    drawn = rows.join(table, F.col("_of").eqNullSafe(F.col("_source"))).withColumn("copies", (F.col("low") + F.size(F.filter("cdf", lambda c: c <= F.col("_u")))).cast("int"))
    each = drawn.where("copies > 0").select("row", "_id", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit("order"), F.lit(str(seed)), F.col("_id"), F.col("copy").cast("string")))
    return each.select("row", "copies", "copy", key.alias("shuffle_key"))


def positions(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, copies, copy, position): the place of each copy in the shuffled order, from 0."""
    rows = replicated(docs, weights, epochs, seed, id_col, source_col, text_col, keep=[id_col, source_col]).select("row.*", "copies", "copy", "shuffle_key")
    return with_position(rows, ["shuffle_key", id_col, "copy"]).select(id_col, source_col, "copies", "copy", "position")


def shuffled(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, rows repeated and in shuffled order over range partitions."""
    rows = replicated(docs, weights, epochs, seed, id_col, source_col, text_col)
    n = n_partitions(docs.sparkSession)
    return rows.repartitionByRange(n, "shuffle_key").sortWithinPartitions("shuffle_key").select("row.*")
