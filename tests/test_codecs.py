import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecforge.functions.arrays import hadamard
from vecforge.functions.floats import bf16, e4m3, e8m0, fp16
from vecforge.operators import cache, codec_arrow
from vecforge.operators.bits import bit_table, host_lattice_bits, parameter_grid
from vecforge.operators.codec import ABLATIONS, Codec, ablation, d4, e8, fp8_roundtrip, scalar
from vecforge.operators.lattice import nearest_dn, nearest_e8


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def array(values):
    return F.array(*[F.lit(float(v)) for v in values])


@pytest.mark.parametrize(
    ("point", "want"),
    [
        ((0.75, 0.25, 0, 0), (0, 0, 0, 0)),
        ((0.25, 0.75, 0, 0), (1, 1, 0, 0)),
        ((1, 0, 0, 0), (2, 0, 0, 0)),
        ((-1, 0, 0, 0), (0, 0, 0, 0)),
        ((0.5,) * 4, (0,) * 4),
        ((2.5, 0.5, 0, 0), (2, 0, 0, 0)),
        ((-0.6, 0.2, 0.1, 0), (0, 0, 0, 0)),
    ],
)
def test_nearest_d4(spark, point, want):
    assert one(spark, nearest_dn(array(point))) == [float(w) for w in want]


@pytest.mark.parametrize(("point", "want"), [((0.5,) * 8, (0.5,) * 8), ((0.25,) * 8, (0,) * 8), ((0.3,) * 8, (0.5,) * 8), ((1,) + (0,) * 7, (2,) + (0,) * 7), ((1.5,) * 8, (1.5,) * 8)])
def test_nearest_e8(spark, point, want):
    assert one(spark, nearest_e8(array(point))) == [float(w) for w in want]


def test_narrow_floats(spark):
    cases = {2.0**-14: 2.0**-14, 2.0**-24: 2.0**-24, 2.0**-25: 0.0, 3 * 2.0**-25: 2.0**-23, 65504.0: 65504.0, 65519.0: 65504.0, 65520.0: math.inf, 0.1: 0.0999755859375, -0.1: -0.0999755859375, 0.0: 0.0}
    for x, want in cases.items():
        assert one(spark, fp16(F.lit(x))) == want
    rng = np.random.default_rng(1)
    x = np.minimum(np.exp(rng.normal(size=2000) * 3), 6e4) * rng.choice([-1, 1], 2000)
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(fp16(F.col("x"))).collect()]
    assert np.array_equal(np.array(got), x.astype(np.float16).astype(float))
    assert one(spark, bf16(F.lit(1.00390625))) == 1.0 and one(spark, e4m3(F.lit(1000.0))) == 448.0 and one(spark, e4m3(F.lit(17.0))) == 16.0
    assert one(spark, e8m0(F.lit(130))) == 8.0


def test_frozen_bits(spark):
    frozen = {"d4": {4: 416, 10: 576, 38: 832, 152: 1088}, "e8": {4: 448, 10: 608, 38: 848, 152: 1104}}
    rows = bit_table(parameter_grid(spark, {v: list(q) for v, q in frozen.items()}, [128])).collect()
    assert {(r.variant, r.q): r.bits for r in rows} == {(v, q): b for v, qs in frozen.items() for q, b in qs.items()}
    assert [host_lattice_bits("e8", 512, q) for q in (1, 10, 38, 76)] == [864, 2336, 3296, 3808]


def test_hadamard_matches_matrix(spark):
    x = np.random.default_rng(2).normal(size=16)
    i = np.arange(16)
    matrix = np.where(np.bitwise_count(i[:, None] & i[None, :]) % 2 == 0, 1, -1) / 4
    assert np.allclose(one(spark, hadamard(array(x), 16)), x @ matrix)


def vectors(spark, n=60, dims=64, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dims)) * 0.3
    return x, spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i int, x array<double>")


@pytest.mark.parametrize("variant", ["d4", "e8", "zn"])
@pytest.mark.parametrize("q", [4, 38])
def test_native_equals_array_kernel(spark, variant, q):
    x, df = vectors(spark)
    got = np.array([r[0] for r in df.orderBy("i").select(Codec(variant, 64, q).roundtrip(F.col("x"))).collect()])
    want = next(codec_arrow.roundtrips(x, [(variant, q)]))[2]
    assert np.abs(got - want).max() < 1e-12


def test_error_falls_with_range_and_thresholds(spark):
    x, df = vectors(spark, 200)
    sweep = codec_arrow.sweep(df, [(v, q) for v in ("d4", "e8") for q in (4, 10, 38, 152)], "x").collect()
    error = {(r.variant, r.q): r.rel_mse for r in sweep}
    for v in ("d4", "e8"):
        assert error[v, 4] > error[v, 10] > error[v, 38] > error[v, 152]
        assert error[v, 152] < 1e-3 and error[v, 38] < 1e-2 and error[v, 4] < 0.2
    assert all(error["e8", q] < error["d4", q] for q in (4, 10, 38, 152))


def test_zero_scale_and_repartition(spark):
    x, df = vectors(spark)
    codec = d4(64, 38)
    assert one(spark, codec.roundtrip(array([0] * 64))) == [0.0] * 64
    plain = [r[0] for r in df.orderBy("i").select(codec.roundtrip(F.col("x"))).collect()]
    again = [r[0] for r in df.repartition(37).orderBy("i").select(codec.roundtrip(F.col("x"))).collect()]
    doubled = [r[0] for r in df.orderBy("i").select(codec.roundtrip(F.transform("x", lambda v: v * 4))).collect()]
    assert plain == again
    assert np.allclose(np.array(doubled), 4 * np.array(plain), atol=0)


def test_ablations(spark):
    x, df = vectors(spark)
    full = [r[0] for r in df.orderBy("i").select(ablation("v14_full", 64, 38).roundtrip(F.col("x"))).collect()]
    base = [r[0] for r in df.orderBy("i").select(d4(64, 38).roundtrip(F.col("x"))).collect()]
    assert full == base and set(ABLATIONS) == {"v14_full", "no_unit_norm", "no_hadamard", "global_qmax", "per_block_qmax", "scalar_quantise"}
    with pytest.raises(ValueError, match="unknown ablation"):
        ablation("nothing", 64, 38)


@pytest.mark.parametrize("make", [lambda: Codec("d5", 64, 3), lambda: d4(96, 3), lambda: e8(4, 3), lambda: d4(64, 0)])
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_defaults_and_small_heads():
    assert d4(128).q == 152 and e8(128).q == 37 and scalar(64, 4).q == 7
    assert d4(32, 38).dims == 32 and d4(128, 38).bits == 832


def test_fp8(spark):
    x, df = vectors(spark)
    y = np.array([r[0] for r in df.orderBy("i").select(fp8_roundtrip(F.col("x"), 64)).collect()])
    assert ((x - y) ** 2).sum() / (x**2).sum() < 2e-3
    kept = np.array([r[0] for r in df.orderBy("i").select(fp8_roundtrip(F.concat("x", "x"), 128, keep_last=64)).collect()])
    assert np.array_equal(kept[:, 64:], x) and np.array_equal(kept[:, :64], y)
    with pytest.raises(ValueError):
        fp8_roundtrip(F.col("x"), 96)


def test_layer_codecs():
    made = cache.layer_codecs(6, 2, 64, "d4", 38)
    assert [i for i, c in made.items() if c] == [2, 3]
    with pytest.raises(ValueError, match="power of two"):
        cache.layer_codecs(6, 2, 96, "d4", 38)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert set(cache.layer_codecs(6, 2, 96, "d4", 38, strict=False).values()) == {None} and seen
