"""Grouped statistics, pairings and threshold solvers over measurement tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-sided 95 % points of Student's t, by degrees of freedom. Fixed values of the two reporting conventions.
T_BELOW = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 15: 2.131, 20: 2.086, 25: 2.060, 30: 2.042, 32: 2.037, 40: 2.021, 50: 2.009, 60: 2.000, 100: 1.984}
T_ABOVE = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179, 15: 2.131, 20: 2.086, 30: 2.042, 60: 2.000, 120: 1.980}
NORMAL = 1.96
#: Bits and range of the scalar and D4 codecs that are compared. Fixed values.
PAIRS = ((4, 10), (6, 38), (8, 152))
#: Accuracy of the percentiles that enclose an order statistic.
ACCURACY = 10_000


def _table(points: dict[int, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in points.items() for x in kv])


def t_below(df: Column) -> Column:
    """The entry of the largest tabulated number up to ``df``; the normal value beyond 100."""
    at = F.array_max(F.filter(F.map_keys(_table(T_BELOW)), lambda k: k <= df))
    return F.when(df > 100, NORMAL).otherwise(_table(T_BELOW)[F.coalesce(at, F.lit(1))])


def t_above(df: Column) -> Column:
    """The entry of the smallest tabulated number from ``df`` on; the normal value past the end."""
    at = F.array_min(F.filter(F.map_keys(_table(T_ABOVE)), lambda k: k >= df))
    return F.coalesce(_table(T_ABOVE)[at], F.lit(NORMAL))


def mean_ci(df: DataFrame, value: str, by: Sequence[str], above: bool = False) -> DataFrame:
    """(by, mean, ci95, std, n): half-widths are 0 for a single value."""
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    t = (t_above if above else t_below)((F.col("n") - 1).cast("int"))
    return out.select(*by, "mean", F.when(F.col("n") <= 1, 0.0).otherwise(t * F.col("std") / F.sqrt("n")).alias("ci95"), F.when(F.col("n") <= 1, 0.0).otherwise(F.col("std")).alias("std"), "n")


def usable(records: DataFrame) -> DataFrame:
    """Records without those that report a fatal error."""
    return records.where(F.col("fatal").isNull())


def melted(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(by, metric, value): one row for each metric."""
    return df.unpivot(list(by), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def channel_aggregate(records: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("channel",), above: bool = False) -> DataFrame:
    """Mean and interval of each metric of each channel, in one pass over the melted table."""
    return mean_ci(melted(usable(records), by, metrics), "value", [*by, "metric"], above)


def channel_means(records: DataFrame, metrics: Sequence[str], constants: Sequence[str], by: Sequence[str] = ("channel",), first: str = "passage") -> DataFrame:
    """Means of the metrics; constants come from the record with the smallest ``first``."""
    return usable(records).groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], *[F.min_by(c, first).alias(c) for c in constants])


def head_to_head(means: DataFrame, value: str, pairs: Sequence[tuple[int, int]] = PAIRS) -> DataFrame:
    """(b, q, scalar, d4, ratio) of the fixed pairs, from rows (codec, param, value)."""
    spark = means.sparkSession
    wanted = F.broadcast(spark.createDataFrame([tuple(p) for p in pairs], "b int, q int"))
    tq = means.where("codec = 'tq'").select(F.col("param").alias("b"), F.col(value).alias("scalar"))
    d4 = means.where("codec = 'd4'").select(F.col("param").alias("q"), F.col(value).alias("d4"))
    return tq.join(wanted, "b").join(d4, "q").select("b", "q", "scalar", "d4", (F.col("d4") / F.col("scalar")).alias("ratio"))


def matched(means: DataFrame, value: str, left: str = "e8", right: str = "d4") -> DataFrame:
    """(param, left, right, ratio) of two codecs at the same parameter, in one pass."""
    sides = [F.max(F.when(F.col("codec") == c, F.col(value))).alias(c) for c in (left, right)]
    both = means.groupBy("param").agg(*sides).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return both.withColumn("ratio", F.col(left) / F.col(right))


def with_baseline(means: DataFrame, key: str, value: str, baseline: str) -> DataFrame:
    """Every row with ``base``, the value of the baseline's row (null without one), in one pass.

    means: one row for each codec; these few rows become one array."""
    rows = means.agg(F.collect_list(F.struct(*means.columns)).alias("rows"))
    base = F.array_max(F.transform(F.filter("rows", lambda r: r[key] == baseline), lambda r: r[value]))
    return rows.select(base.alias("base"), F.explode("rows").alias("r")).select("r.*", "base")


def overhead(means: DataFrame, value: str, baseline: str) -> DataFrame:
    """Every row over the single row of the baseline."""
    return with_baseline(means, "codec", value, baseline).withColumn("overhead", F.col(value) / F.col("base")).drop("base")


def first_admissible(sweep: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each stream, threshold and view, the smallest q whose mean (``point``) or upper end (``ci``) is within
    multiplier x baseline; streams without one keep a row with nulls.

    sweep: (stream, q, mean, ci95, baseline); thresholds: (multiplier)."""
    views = sweep.select("stream", "q", "mean", "baseline", F.explode(F.array(F.struct(F.lit("point").alias("view"), F.col("mean").alias("value")), F.struct(F.lit("ci").alias("view"), (F.col("mean") + F.col("ci95")).alias("value")))).alias("v"))
    each = views.select("stream", "q", "mean", "baseline", "v.*").crossJoin(F.broadcast(thresholds))
    fits = F.col("value") <= F.col("multiplier") * F.col("baseline")
    best = F.min(F.when(fits, F.struct("q", "mean")))
    return each.groupBy("stream", "view", "multiplier").agg(best.alias("b")).select("stream", "view", "multiplier", F.col("b.q").alias("q"), F.col("b.mean").alias("mean"))


def admissibility(ratio: Column) -> Column:
    """A up to 1, B up to 1.05, C up to 1.2, else a dash."""
    return F.when(ratio <= 1.0, "A").when(ratio <= 1.05, "B").when(ratio <= 1.2, "C").otherwise("-")


def best_compression(means: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(family, threshold, channel, ratio): the most compressed channel whose mean absolute change is within it.

    means: (family, channel, change, ratio); thresholds: (threshold)."""
    met = means.crossJoin(F.broadcast(thresholds)).where(F.col("change") <= F.col("threshold"))
    top = F.max(F.struct("ratio", "channel")).alias("t")
    return met.groupBy("family", "threshold").agg(top).select("family", "threshold", "t.channel", "t.ratio")


def accuracy(records: DataFrame, by: Sequence[str] = ("channel",)) -> DataFrame:
    return records.groupBy(*by).agg(F.sum("n_correct").alias("n_correct"), F.sum("n_trials").alias("n_trials"), (F.sum("n_correct") / F.sum("n_trials")).alias("accuracy"))


def accuracy_rollup(records: DataFrame) -> DataFrame:
    """Per cell, per context length, per channel and over all."""
    return records.rollup("channel", "ctx_len", "depth").agg(F.sum("n_correct").alias("n_correct"), F.sum("n_trials").alias("n_trials"))


def heat_map(records: DataFrame, depths: Sequence[float]) -> DataFrame:
    """Accuracy by context length and channel, one column for each depth."""
    out = records.groupBy("ctx_len", "channel").pivot("depth", list(depths)).agg(F.sum("n_correct") / F.sum("n_trials"))
    return out.select("ctx_len", "channel", *[F.col(f"`{d}`").alias(f"d{str(d).replace('.', '_')}") for d in depths])


def majority(df: DataFrame, value: str) -> DataFrame:
    """The most frequent value, the smaller on ties; one row."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.agg(F.max(F.struct("n", (-F.col(value)).alias("minus"))).alias("m")).select((-F.col("m.minus")).alias(value), F.col("m.n").alias("n"))


def order_statistics(df: DataFrame, value: str, by: Sequence[str], places: Mapping[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """(by, n, one column for each place): exact values at given places of each group's order, from 0.

    places: name -> (share of the rows that lie below, place as an expression of their number). Approximate percentiles
    enclose a place; smaller values are only counted, and only those between are put in order: at most
    six in ``ACCURACY`` of a large group's rows, so that no task sorts a group."""
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    shares = [min(max(p + side * 3 / ACCURACY, 0.0), 1.0) for p, _ in places.values() for side in (-1, 1)]
    first = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", shares, ACCURACY).alias("_p"))
    small = F.col("n") <= ACCURACY
    ends = lambda i: (F.when(small, F.col("_min")).otherwise(F.col("_p")[2 * i]), F.when(small, F.col("_max")).otherwise(F.col("_p")[2 * i + 1]))
    marks = [F.struct(F.lit(name).alias("_name"), place(F.col("n")).cast("long").alias("_place"), ends(i)[0].alias("_low"), ends(i)[1].alias("_high")) for i, (name, (_, place)) in enumerate(places.items())]
    sized = first.select(*by, "n", F.array(*marks).alias("_marks"))
    keys = [F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by]
    met = own.alias("o").join(sized.alias("s"), keys) if by else own.alias("o").crossJoin(sized.alias("s"))
    each = met.select(*[f"o.{k}" for k in by], "o._v", "s.n", F.explode("s._marks").alias("m")).select(*by, "_v", "n", "m.*")
    inside = each.where(F.col("_v").between(F.col("_low"), F.col("_high")))
    below = each.groupBy(*by, "_name").agg(F.sum((F.col("_v") < F.col("_low")).cast("long")).alias("_below"))
    ranked = inside.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_name").orderBy("_v")) - 1)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*by, "_name"]]
    found = ranked.alias("r").join(below.alias("b"), same).where(F.col("r._rank") + F.col("b._below") == F.col("r._place"))
    return found.select(*[f"r.{k}" for k in by], "r.n", "r._name", "r._v").groupBy(*by, "n").agg(*[F.max(F.when(F.col("_name") == p, F.col("_v"))).alias(p) for p in places])


def latency(df: DataFrame, value: str, by: Sequence[str], vectors: int) -> DataFrame:
    """Mean, deviation, extremes and ordered-index percentiles: entry n//2, and entry floor(0.99 n) but the last at most."""
    places = {"p50": (0.5, lambda n: F.floor(n / 2)), "p99": (0.99, lambda n: F.least(n - 1, F.floor(0.99 * n)))}
    sums = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = sums.join(order_statistics(df, value, by, places), list(by))
    return out.withColumn("per_vector", F.col("mean") / vectors).withColumn("million_per_sec", F.lit(float(vectors)) / F.col("mean"))


def slowdown(runs: DataFrame, baseline: str) -> DataFrame:
    """(variant, ppl, decode_s, slowdown): means by variant and decoding time over the baseline's."""
    means = runs.groupBy("variant").agg(F.avg("ppl").alias("ppl"), F.avg("decode_s").alias("decode_s"))
    return with_baseline(means, "variant", "decode_s", baseline).select("variant", "ppl", "decode_s", (F.col("decode_s") / F.col("base")).alias("slowdown"))


def layer_mean(df: DataFrame, value: str, by: Sequence[str], layer: str) -> DataFrame:
    """Mean over layers of the mean within each layer, unweighted."""
    per = df.groupBy(*by, layer).agg(F.avg(value).alias(value))
    return per.groupBy(*by).agg(F.avg(value).alias(value))
