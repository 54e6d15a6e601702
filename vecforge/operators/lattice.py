"""Nearest lattice points as array expressions. Rounding is half to even; ``pmod`` keeps parities non-negative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecforge.functions.arrays import let, squared_norm


def nearest_zn(block: Column) -> Column:
    """The nearest integer point."""
    return F.transform(block, F.rint)


def nearest_dn(block: Column) -> Column:
    """The nearest integer point of even sum, for D4 and D8.

    If the rounded sum is odd, the coordinate that lies furthest from its integer, the first on ties, moves one step
    towards the value; a residual of zero moves up."""

    def repair(point: Column) -> Column:
        residual = F.zip_with(block, point, lambda y, p: y - p)

        def flip(off: Column) -> Column:
            sizes = F.transform(off, F.abs)
            at = F.array_position(sizes, F.array_max(sizes)) - 1
            return F.transform(point, lambda p, i: F.when(i == at, p + F.when(off[i] >= 0, 1.0).otherwise(-1.0)).otherwise(p))

        odd = F.pmod(F.aggregate(point, F.lit(0.0), lambda acc, p: acc + p), F.lit(2.0)) != 0
        return F.when(odd, let(residual, flip)).otherwise(point)

    return let(nearest_zn(block), repair)


def nearest_e8(block: Column) -> Column:
    """The nearest point of D8 or of D8 shifted by one half; the integer one on ties."""

    def distance(point: Column) -> Column:
        return squared_norm(F.zip_with(block, point, lambda y, p: y - p))

    half = F.transform(nearest_dn(F.transform(block, lambda y: y - 0.5)), lambda p: p + 0.5)
    return let(F.struct(nearest_dn(block).alias("a"), half.alias("b")), lambda s: F.when(distance(s["a"]) <= distance(s["b"]), s["a"]).otherwise(s["b"]))


#: Block size and search of each lattice.
LATTICES = {"d4": (4, nearest_dn), "e8": (8, nearest_e8), "zn": (1, nearest_zn)}
