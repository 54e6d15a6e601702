"""Array expressions: everything stays on the JVM and needs no shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest positive step of a 32-bit float at one; norms and scales never go below it. Fixed value.
EPS = 1.1920928955078125e-07


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def as_doubles(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def total(vec: Column) -> Column:
    """Left-to-right sum."""
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_norm(vec: Column) -> Column:
    return total(F.transform(vec, lambda x: x * x))


def norm(vec: Column, eps: float = EPS) -> Column:
    return F.greatest(F.sqrt(squared_norm(vec)), F.lit(eps))


def largest(vec: Column, eps: float = EPS) -> Column:
    """The largest magnitude, at least ``eps``."""
    return F.greatest(F.array_max(F.transform(vec, F.abs)), F.lit(eps))


def scaled(vec: Column, factor: Column) -> Column:
    return F.transform(vec, lambda x: x * factor)


def divided(vec: Column, divisor: Column) -> Column:
    return F.transform(vec, lambda x: x / divisor)


def clamped(vec: Column, bound: float) -> Column:
    return F.transform(vec, lambda x: F.greatest(F.lit(-float(bound)), F.least(F.lit(float(bound)), x)))


def blocks(vec: Column, dims: int, size: int) -> Column:
    """The vector as an array of blocks."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims // size - 1)), lambda k: F.slice(vec, k * size + 1, F.lit(size)))


def hadamard(vec: Column, dims: int, normalised: bool = True) -> Column:
    """Product with the Hadamard matrix: log2(dims) rounds of sums and differences; its own inverse if normalised."""
    if dims & (dims - 1):
        raise ValueError(f"dims must be a power of two, got {dims}")
    if dims == 1:
        return vec
    steps = F.array(*[F.lit(1 << s) for s in range(int(math.log2(dims)))])
    places = F.sequence(F.lit(0), F.lit(dims - 1))

    def round_(acc: Column, h: Column) -> Column:
        return F.transform(places, lambda i: F.when(i.bitwiseAND(h) == 0, acc[i] + acc[i + h]).otherwise(acc[i - h] - acc[i]))

    out = F.aggregate(steps, vec, round_)
    return divided(out, F.lit(math.sqrt(dims))) if normalised else out
