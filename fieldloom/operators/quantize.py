"""Quantisers: error-bounded, symbols around a mean, variable step, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eb_code(x: Column, bound: float, mode: str = "strict") -> Column:
    """An integer code with step ``2 * bound``.

    ``strict`` rounds half to even, so that the error stays within the bound;
    ``shifted`` takes one more from values below minus half a step, as some
    existing streams do.
    """
    s = x / (2 * bound)
    if mode == "strict":
        return F.rint(s).cast("long")
    if mode == "shifted":
        return F.floor(s + 0.5).cast("long") - F.when(s < -0.5, 1).otherwise(0)
    raise ValueError(f"unknown mode: {mode}")


def eb_value(code: Column, bound: float) -> Column:
    return code * (2 * bound)


def symbol(x: Column, mean: Column) -> Column:
    """The integer nearest to ``x - mean``, halves to even."""
    return F.rint(x - mean).cast("long")


def symbol_value(s: Column, mean: Column) -> Column:
    return s + mean


def stepped(x: Column, mean: Column, step: Column) -> Column:
    """``x`` on the grid of ``step`` through ``mean``."""
    return F.rint((x - mean) / step) * step + mean


def truncated(x: Column, bits: int = 16) -> Column:
    """Towards zero, wrapped into signed ``bits`` bits."""
    half = 1 << (bits - 1)
    return F.pmod(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long") + half, F.lit(1 << bits)) - half


def residual_code(x: Column, approx: Column, bound: float) -> Column:
    """The code of what an approximation misses."""
    return F.rint((x - approx) / (2 * bound)).cast("long")


def residual_value(approx: Column, code: Column, bound: float) -> Column:
    """An approximation mended to within ``bound``."""
    return approx + code * (2 * bound)


def width_of(low: Column, high: Column) -> Column:
    """Bits of the smallest signed integer type that holds both ends."""
    fits = lambda bits: (low >= -(1 << (bits - 1))) & (high < (1 << (bits - 1)))
    return F.when(fits(8), 8).when(fits(16), 16).when(fits(32), 32).otherwise(64)
