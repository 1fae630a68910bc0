"""Per-slice statistics and reversible normalisation of fields (n, h, w, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def slice_stats(field: DataFrame) -> DataFrame:
    """(n, vmin, vmax, vmean, vstd, cells): one row per slice; the deviation is the population's."""
    return field.groupBy("n").agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.avg("v").alias("vmean"), F.stddev_pop("v").alias("vstd"), F.count("v").alias("cells"))


def with_stats(field: DataFrame) -> DataFrame:
    """``field`` with its slice's statistics; map-side sums, then a join on the slice."""
    return field.join(slice_stats(field), "n")


def scaled(kind: str, eps: float = EPS) -> Column:
    """The normalised value of a row that carries its slice's statistics."""
    v = F.col("v")
    if kind == "none":
        return v
    if kind == "minmax":
        return (v - F.col("vmin")) / F.greatest(F.col("vmax") - F.col("vmin"), F.lit(eps))
    if kind == "meanstd":
        return (v - F.col("vmean")) / F.greatest(F.col("vstd"), F.lit(eps))
    raise ValueError(f"unknown normalisation: {kind}")


def normalize(field: DataFrame, kind: str = "minmax", eps: float = EPS) -> DataFrame:
    """(n, h, w, v, x and the statistics): ``x`` is ``v`` normalised within its slice."""
    return with_stats(field).withColumn("x", scaled(kind, eps))


def denormalized(x: Column) -> Column:
    """The inverse of min-max scaling; a constant slice gives its minimum."""
    return x * (F.col("vmax") - F.col("vmin")) + F.col("vmin")


def minmax_bits(v: Column, low: Column, high: Column, bits: int = 8, eps: float = 1e-8, most: int = 32767) -> Column:
    """Min-max scaling to ``bits`` bits, clipped to the code range."""
    return F.least(F.greatest((v - low) / (high - low + eps) * (1 << bits), F.lit(0.0)), F.lit(float(most)))


def minmax_bits_inverse(code: Column, low: Column, high: Column, bits: int = 8) -> Column:
    return code / (1 << bits) * (high - low) + low


def log_code(v: Column, most_log: Column, bits: int = 8, most: int = 32767) -> Column:
    """A signed logarithmic code, scaled by the largest log magnitude; null where all values are 0."""
    magnitude = F.least(F.greatest(F.try_divide(F.log1p(F.abs(v)), most_log) * (1 << bits), F.lit(0.0)), F.lit(float(most)))
    return F.signum(v) * magnitude


def log_code_inverse(code: Column, most_log: Column, bits: int = 8) -> Column:
    return F.signum(code) * F.expm1(F.abs(code) / (1 << bits) * most_log)


def uniform_code(v: Column, mean: Column, std: Column, eps: float = 1e-7) -> Column:
    """Standardised values clipped to sixteen signed bits."""
    spread = F.when(std == 0, F.lit(eps)).otherwise(std) + eps
    return F.least(F.greatest((v - mean) / spread, F.lit(-32768.0)), F.lit(32767.0))


def uniform_code_inverse(code: Column, mean: Column, std: Column) -> Column:
    return code * std + mean
