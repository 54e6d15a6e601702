"""Quality of reconstructions as aggregations; each takes per-row sums, so partial sums are combined before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforge.functions.arrays import as_doubles, dot, hadamard, squared_norm
from vecforge.operators.codec import FP8_BLOCK, Codec, fp8_roundtrip
from vecforge.operators.stats import order_statistics

LEAST = 1e-12


def squared_error(x: Column, y: Column) -> Column:
    return squared_norm(F.zip_with(as_doubles(x), as_doubles(y), lambda a, b: a - b))


def relative_mse(df: DataFrame, x: str, y: str, by: Sequence[str] = (), clamp: bool = True) -> DataFrame:
    """Uncentred: mean squared error over mean squared norm."""
    n2 = F.avg(squared_norm(as_doubles(F.col(x))))
    return df.groupBy(*by).agg((F.avg(squared_error(F.col(x), F.col(y))) / (F.greatest(n2, F.lit(LEAST)) if clamp else n2)).alias("rel_mse"))


def centred_relative_mse(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Squared error over the squared distance from the mean of each coordinate, in one pass over exploded coordinates."""
    each = df.select(*by, F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("at", "v"))
    a, b = F.col("v.x").cast("double"), F.col("v.y").cast("double")
    per = each.groupBy(*by, "at").agg(F.sum((a - b) * (a - b)).alias("num"), (F.var_pop(a) * F.count("*")).alias("den"))
    return per.groupBy(*by).agg((F.sum("num") / F.greatest(F.sum("den"), F.lit(LEAST))).alias("rel_mse"))


def layer_weighted_mse(df: DataFrame, num: Column, den: Column, layers: Column, by: Sequence[str] = ()) -> DataFrame:
    """Sums of squares of several head sizes, weighted by their number of layers."""
    return df.groupBy(*by).agg((F.sum(layers * num) / F.sum(layers * den)).alias("rel_mse"))


def cosine(x: Column, y: Column, each: bool = True) -> Column:
    """Cosine of two vectors; ``each``: both norms are held above the least value, else their product is."""
    a, b = as_doubles(x), as_doubles(y)
    na, nb = F.sqrt(squared_norm(a)), F.sqrt(squared_norm(b))
    low = F.lit(LEAST)
    return dot(a, b) / (F.greatest(na, low) * F.greatest(nb, low) if each else F.greatest(na * nb, low))


def cosine_stats(df: DataFrame, x: str, y: str, by: Sequence[str] = (), each: bool = True) -> DataFrame:
    c = cosine(F.col(x), F.col(y), each)
    return df.groupBy(*by).agg(F.avg(c).alias("cos_mean"), F.min(c).alias("cos_min"))


def head_to_head(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Absolute and relative error, mean and least cosine of each group."""
    e, n2, c = squared_error(F.col(x), F.col(y)), squared_norm(as_doubles(F.col(x))), cosine(F.col(x), F.col(y))
    return df.groupBy(*by).agg(F.avg(e).alias("mse"), (F.avg(e) / F.greatest(F.avg(n2), F.lit(LEAST))).alias("rel_mse"), F.avg(c).alias("cos_mean"), F.min(c).alias("cos_min"), F.count("*").alias("n"))


def gain_db(reference: Column, other: Column) -> Column:
    """How far ``other`` lies below ``reference``, in decibels."""
    low = F.lit(LEAST)
    return 10 * F.log10(F.greatest(reference, low) / F.greatest(other, low))


def differences(df: DataFrame, x: str, y: str) -> DataFrame:
    """(differing, largest, mean): coordinates of two runs of the same rows."""
    each = df.select(F.explode(F.zip_with(as_doubles(F.col(x)), as_doubles(F.col(y)), lambda a, b: F.abs(a - b))).alias("d"))
    return each.agg(F.sum((F.col("d") != 0).cast("long")).alias("differing"), F.max("d").alias("largest"), F.avg("d").alias("mean"))


def top1(logprobs: Column) -> Column:
    """The id of the largest log-probability of a map, the smaller id on ties; -1 for null or empty."""
    entries = F.transform(F.map_entries(logprobs), lambda e: F.struct(e["value"].alias("lp"), (-e["key"]).alias("minus")))
    return F.coalesce(-F.array_max(entries)["minus"], F.lit(-1))


def clipped_perplexity(loss: Column) -> Column:
    return F.exp(F.least(F.lit(20.0), loss))


def delta_perplexity(ref: Column, alt: Column) -> Column:
    return (alt - ref) / F.greatest(ref, F.lit(1e-9))


def perplexity_and_agreement(ref: DataFrame, alt: DataFrame, by: Sequence[str] = ("passage",)) -> DataFrame:
    """Two runs (passage, pos, gold_id, logprobs MAP<INT,DOUBLE>) side by side: perplexities, change, top-1 agreement."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*by, "pos", F.coalesce(F.col("logprobs")[F.col("gold_id")], F.lit(0.0)).alias(f"lp_{name}"), top1(F.col("logprobs")).alias(f"top_{name}"))

    both = side(alt, "alt").join(side(ref, "ref"), [*by, "pos"], "left")
    same = (F.col("top_alt") == F.col("top_ref")) & (F.col("top_alt") != -1)
    out = both.groupBy(*by).agg(F.exp(-F.avg("lp_ref")).alias("ppl_ref"), F.exp(-F.avg("lp_alt")).alias("ppl_alt"), F.avg(F.coalesce(same, F.lit(False)).cast("double")).alias("top1_pair"))
    return out.withColumn("delta_ppl", delta_perplexity(F.col("ppl_ref"), F.col("ppl_alt")))


def audit(df: DataFrame, vec: str, dims: int, by: Sequence[str] = (), short: bool = False) -> DataFrame:
    """How far vectors are from independent Gaussians: excess kurtosis, spread of variances before and after rotation,
    and the root mean square of the tail deviation p99(|z|)/2.326 - 1.

    Coordinates are exploded once; the rotation is of the raw vector."""
    x = as_doubles(F.col(vec))
    pairs = F.arrays_zip(x.alias("x"), hadamard(x, dims).alias("y"))
    each = df.select(*by, F.posexplode(pairs).alias("at", "v")).select(*by, "at", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    low = F.lit(LEAST)
    first = each.groupBy(*by, "at").agg(F.kurtosis("x").alias("kurt"), F.var_pop("x").alias("var"), F.var_pop("y").alias("var_y"), F.avg("x").alias("mu"), F.count("*").alias("n"))
    ratio = lambda c: F.greatest(F.max(c), low) / F.greatest(F.min(c), low)
    summary = [F.avg(F.abs("kurt")).alias("excess_kurtosis_abs"), ratio("var").alias("isotropy_variance_ratio")]
    if short:
        return first.groupBy(*by).agg(*summary)
    z = each.join(first.select(*by, "at", "mu", "var"), [*by, "at"]).withColumn("z", F.abs((F.col("x") - F.col("mu")) / F.greatest(F.sqrt("var"), F.lit(1e-6))))
    # the 99th percentile, between two neighbours in order
    at = lambda n: 0.99 * (n - 1)
    tails = order_statistics(z, "z", [*by, "at"], {"low": (0.99, lambda n: F.floor(at(n))), "high": (0.99, lambda n: F.ceil(at(n)))})
    p99 = F.col("low") + (F.col("high") - F.col("low")) * (at(F.col("n")) - F.floor(at(F.col("n"))))
    both = first.join(tails.select(*by, "at", (p99 / 2.326 - 1).alias("tail")), [*by, "at"])
    return both.groupBy(*by).agg(*summary, ratio("var_y").alias("hadamard_post_variance_ratio"), F.sqrt(F.avg(F.col("tail") * F.col("tail"))).alias("rms_wasserstein2_over_sigma_per_dim"), F.max("n").alias("num_vectors"), F.count("*").alias("dims"))


def ratio_to_baseline(df: DataFrame, value: str, keys: Sequence[str], codec: str, baseline: str, name: str = "ratio") -> DataFrame:
    """The row of one codec over the baseline's row of the same keys, in one pass; a missing or zero baseline gives no row."""
    side = lambda c: F.max(F.when(F.col("codec") == c, F.col(value)))
    both = df.groupBy(*keys).agg(side(codec).alias("_own"), side(baseline).alias("_base"))
    return both.where("_own is not null and _base <> 0").select(*keys, (F.col("_own") / F.col("_base")).alias(name))


def stream_records(df: DataFrame, vec: str, dims: int, codecs: Mapping[str, Codec], by: Sequence[str]) -> DataFrame:
    """(by, audit STRUCT, codecs MAP<name, STRUCT<bits, rel_mse, cos_sim>>): one record for each group, with the FP8
    baseline among the codecs.

    All codecs are summed up in one pass over the rows."""
    x = as_doubles(F.col(vec))
    decoded = {name: codec.roundtrip(x) for name, codec in codecs.items()} | {"fp8": fp8_roundtrip(x, dims)}
    bits = {name: codec.bits for name, codec in codecs.items()} | {"fp8": 8 * dims + dims // FP8_BLOCK * 16}
    rows = df.select(*by, x.alias("x"), F.struct(*[y.alias(n) for n, y in decoded.items()]).alias("y"))
    sums = [f for n in decoded for f in (F.avg(squared_error(F.col("x"), F.col("y")[n])).alias(f"{n}_e"), F.avg(cosine(F.col("x"), F.col("y")[n])).alias(f"{n}_c"))]
    means = rows.groupBy(*by).agg(F.avg(squared_norm(F.col("x"))).alias("n2"), *sums)
    each = [x for n in decoded for x in (F.lit(n), F.struct(F.lit(bits[n]).alias("bits"), (F.col(f"{n}_e") / F.greatest("n2", F.lit(LEAST))).alias("rel_mse"), F.col(f"{n}_c").alias("cos_sim")))]
    audits = audit(df, vec, dims, by)
    own = audits.select(*by, F.struct(*[c for c in audits.columns if c not in by]).alias("audit"))
    return own.join(means.select(*by, F.create_map(*each).alias("codecs")), list(by))
