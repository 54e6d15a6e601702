"""Rounding to narrow float formats, in double arithmetic; ties go to the even neighbour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats by name: bits after the leading one, smallest normal exponent, largest finite value, whether values beyond
#: it saturate. Fixed values of the formats.
FORMATS = {
    "fp16": (10, -14, 65504.0, False),
    "bf16": (7, -126, 3.3895313892515355e38, False),
    "e4m3": (3, -6, 448.0, True),
}


def rounded_to(x: Column, name: str) -> Column:
    """The value nearest to ``x`` that the format holds, as a double."""
    bits, low, largest, saturates = FORMATS[name]
    size = F.abs(x)
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(low)) - bits)
    value = F.rint(size / unit) * unit
    beyond = F.lit(largest) if saturates else F.lit(float("inf"))
    value = F.when(size == 0, 0.0).when(value > largest, beyond).otherwise(value)
    return F.when(x < 0, -value).otherwise(value)


def fp16(x: Column) -> Column:
    return rounded_to(x, "fp16")


def bf16(x: Column) -> Column:
    return rounded_to(x, "bf16")


def e4m3(x: Column) -> Column:
    return rounded_to(x, "e4m3")


def e8m0(byte: Column) -> Column:
    """The power of two that an exponent-only byte stands for."""
    return F.pow(F.lit(2.0), byte.cast("double") - 127)
