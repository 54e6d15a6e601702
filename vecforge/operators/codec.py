"""Vector codecs as column expressions: encode, decode and round trip of an ``ARRAY<FLOAT>`` column.

A lattice codec divides a vector by its norm, rotates it with the Hadamard matrix, scales it so that the largest
coordinate is Q, moves each block to the nearest lattice point and clamps to Q. Stored are the integers (doubled for
E8, whose points may be halves) and two 16-bit numbers. Decoding works with the stored numbers only. All arithmetic
is double, in a fixed order, so results don't depend on partitioning.

A round trip is one projection: no shuffle, no Python. ``vecforge.operators.codec_arrow`` does the same with array
operations on Arrow batches, for sweeps over many ranges.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforge.functions.arrays import as_doubles, blocks, clamped, divided, hadamard, largest, let, norm, scaled
from vecforge.functions.floats import bf16, e4m3, fp16
from vecforge.operators.bits import OVERHEAD, host_lattice_bits
from vecforge.operators.lattice import LATTICES

#: Default ranges of the two public codecs. Fixed values.
D4_RANGE, E8_RANGE = 152, 37
#: FP8 blocks: size, largest value, smallest block maximum, levels of the uniform fallback. Fixed values.
FP8_BLOCK, FP8_MAX, FP8_LEAST, FP8_LEVELS = 64, 448.0, 1e-4, 127.0


@dataclass(frozen=True)
class Codec:
    """variant: d4, e8 or zn; scale: per ``vector``, per ``block``, or one ``global`` maximum given when used;
    charged: the variant whose bits count, if it is another."""

    variant: str
    dims: int
    q: int
    unit_norm: bool = True
    rotate: bool = True
    scale: str = "vector"
    charged: str | None = None

    def __post_init__(self) -> None:
        if self.variant not in LATTICES:
            raise ValueError(f"unknown variant {self.variant!r}")
        if self.q < 1:
            raise ValueError(f"q must be at least 1, got {self.q}")
        if self.dims < 1 or self.dims & (self.dims - 1):
            raise ValueError(f"dims must be a power of two, got {self.dims}")
        if self.dims % self.block:
            raise ValueError(f"dims must be a multiple of {self.block}, got {self.dims}")

    @property
    def block(self) -> int:
        return LATTICES[self.variant][0] if self.variant != "zn" else 4

    @property
    def bits(self) -> int:
        """Bits of a stored vector; ablated forms are charged like the full one."""
        variant = self.charged or self.variant
        if variant == "zn":
            return self.dims * ((2 * self.q + 1).bit_length()) + OVERHEAD
        return host_lattice_bits(variant, self.dims, self.q)

    @property
    def label(self) -> str:
        return f"{self.variant}_q{self.q}"

    def rotated(self, x: Column, n: Column) -> Column:
        """The vector in the coordinates that are quantised."""
        y = divided(x, n) if self.unit_norm else x
        return hadamard(y, self.dims) if self.rotate else y

    def encode(self, vec: Column, global_max: Column | None = None) -> Column:
        """STRUCT<z ARRAY<INT>, norm DOUBLE, top ARRAY<DOUBLE>>: points, stored norm, stored maxima (one, or per block)."""
        nearest = LATTICES[self.variant][1]
        factor = 2 if self.variant == "e8" else 1

        def tops(y: Column) -> Column:
            if self.scale == "global":
                return F.array(global_max)
            if self.scale == "block":
                return F.transform(blocks(y, self.dims, self.block), lambda b: fp16(largest(b)))
            return F.array(fp16(largest(y)))

        def points(y: Column, top: Column) -> Column:
            def point(b: Column, k: Column) -> Column:
                own = top[k] if self.scale == "block" else top[0]
                return clamped(nearest(divided(b, own / float(self.q))), self.q)

            return F.transform(F.flatten(F.transform(blocks(y, self.dims, self.block), point)), lambda p: (p * factor).cast("int"))

        def coded(x: Column, n: Column) -> Column:
            stored_norm = fp16(n) if self.unit_norm else F.lit(1.0)
            return let(self.rotated(x, n), lambda y: let(tops(y), lambda top: F.struct(points(y, top).alias("z"), stored_norm.alias("norm"), top.alias("top"))))

        return let(as_doubles(vec), lambda x: let(norm(x), lambda n: coded(x, n)))

    def decode(self, code: Column) -> Column:
        """The vector that a code stands for, as doubles."""
        factor = 2.0 if self.variant == "e8" else 1.0

        def values(c: Column) -> Column:
            top = F.transform(c["top"], lambda t: t / float(self.q))
            if self.scale == "block":
                return F.transform(c["z"], lambda z, i: z / factor * top[F.floor(i / self.block).cast("int")])
            return let(top[0], lambda t: F.transform(c["z"], lambda z: z / factor * t))

        def restored(c: Column) -> Column:
            y = values(c)
            return scaled(hadamard(y, self.dims) if self.rotate else y, c["norm"])

        return let(code, restored)

    def roundtrip(self, vec: Column, global_max: Column | None = None) -> Column:
        return self.decode(self.encode(vec, global_max))


def d4(dims: int, q: int = D4_RANGE) -> Codec:
    return Codec("d4", dims, q)


def e8(dims: int, q: int = E8_RANGE) -> Codec:
    return Codec("e8", dims, q)


def scalar(dims: int, b: int) -> Codec:
    """b bits for each coordinate: integers within 2^(b-1) - 1."""
    return Codec("zn", dims, 2 ** (b - 1) - 1)


#: What each ablation leaves out.
ABLATIONS: Mapping[str, Mapping[str, object]] = {
    "v14_full": {},
    "no_unit_norm": {"unit_norm": False},
    "no_hadamard": {"rotate": False},
    "global_qmax": {"scale": "global"},
    "per_block_qmax": {"scale": "block"},
    "scalar_quantise": {"variant": "zn", "charged": "d4"},
}


def ablation(name: str, dims: int, q: int) -> Codec:
    if name not in ABLATIONS:
        raise ValueError(f"unknown ablation {name!r}; known: {', '.join(ABLATIONS)}")
    return replace(d4(dims, q), **ABLATIONS[name])


def calibrate(df: DataFrame, codec: Codec, vec_col: str) -> DataFrame:
    """(global_max): the largest rotated coordinate of a calibration batch, not rounded; one row."""
    y = let(as_doubles(F.col(vec_col)), lambda x: codec.rotated(x, norm(x)))
    return df.agg(F.max(largest(y)).alias("global_max"))


def with_global_max(df: DataFrame, batch: DataFrame, codec: Codec, vec_col: str) -> DataFrame:
    """``df`` with the batch's maximum beside every row: one row, broadcast."""
    return df.crossJoin(F.broadcast(calibrate(batch, codec, vec_col)))


def bf16_roundtrip(vec: Column) -> Column:
    return F.transform(as_doubles(vec), bf16)


def fp8_roundtrip(vec: Column, dims: int, mode: str = "e4m3", keep_last: int = 0) -> Column:
    """Each block of 64 scaled to its own maximum and rounded, to e4m3 values or to 127 even steps (``uniform127``).

    The last ``keep_last`` coordinates pass unchanged."""
    if mode not in ("e4m3", "uniform127"):
        raise ValueError(f"unknown mode {mode!r}")
    coded = dims - keep_last
    if coded % FP8_BLOCK:
        raise ValueError(f"{coded} coordinates are no multiple of {FP8_BLOCK}")
    step = FP8_MAX / FP8_LEVELS

    def one(block: Column) -> Column:
        def rounded(scale: Column) -> Column:
            inside = clamped(divided(block, scale), FP8_MAX)
            values = F.transform(inside, e4m3) if mode == "e4m3" else F.transform(inside, lambda v: F.rint(v / step) * step)
            return scaled(values, scale)

        return let(largest(block, FP8_LEAST) / FP8_MAX, rounded)

    def whole(x: Column) -> Column:
        head = F.flatten(F.transform(blocks(x, coded, FP8_BLOCK), one))
        return F.concat(head, F.slice(x, coded + 1, keep_last)) if keep_last else head

    return let(as_doubles(vec), whole)


def masked_roundtrip(vec: Column, tensor: Column, codec: Codec, mode: str) -> Column:
    """The codec on K, V or both (``mode`` K, V or KV); the other side at bf16."""
    if mode not in ("K", "V", "KV"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(tensor.isin(*mode), codec.roundtrip(vec)).otherwise(bf16_roundtrip(vec))


def dispatched_roundtrip(vec: Column, codecs: Mapping[int, Codec]) -> Column:
    """The codec that fits the vector's length; another length is an error, never a silent pass."""
    out = None
    for dims, codec in codecs.items():
        out = F.when(F.size(vec) == dims, codec.roundtrip(vec)) if out is None else out.when(F.size(vec) == dims, codec.roundtrip(vec))
    error = F.raise_error(F.concat(F.lit("no codec for vectors of length "), F.size(vec).cast("string"))).cast("array<double>")
    return error if out is None else out.otherwise(error)
