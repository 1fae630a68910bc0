"""Planes of pictures (…, h, w, v): chroma resampling, blur, padding, masks, ramps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiling import average_pool, center_shift


def chroma_halved(plane: DataFrame, by: list[str], size: tuple[int, int]) -> DataFrame:
    """A full plane at half the height and width: means of two by two cells."""
    return average_pool(plane, by, size)


def chroma_doubled(plane: DataFrame, by: list[str], size: tuple[int, int], mode: str = "bilinear") -> DataFrame:
    """A plane of ``size`` at twice the height and width, ``nearest`` or ``bilinear`` between cell centres, edges carried on.

    Every cell is sent to the cells that it bears on, with its weight, and these
    are summed up: one exchange and no join.
    """
    if mode == "nearest":
        both = F.array(F.lit(0), F.lit(1))
        out = plane.withColumn("_i", F.explode(both)).withColumn("_j", F.explode(both))
        return out.select(*by, (F.col("h") * 2 + F.col("_i")).alias("h"), (F.col("w") * 2 + F.col("_j")).alias("w"), "v")
    if mode != "bilinear":
        raise ValueError(f"no such mode: {mode}")
    return stencilled(plane, by, (2 * size[0], 2 * size[1]), size, lambda o, n: [(F.greatest(F.lit(0), F.floor((o - 1) / 2)), F.when(o % 2 == 0, 0.25).otherwise(0.75)), (F.least(F.lit(n - 1), F.floor((o + 1) / 2)), F.when(o % 2 == 0, 0.75).otherwise(0.25))], lambda x: (2 * x - 1, 2 * x + 2))


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    """Weights of a normal law at whole steps from the middle, with a sum of 1."""
    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(raw) for x in raw]


def blurred(plane: DataFrame, by: list[str], size: tuple[int, int], kernel: list[float]) -> DataFrame:
    """A plane under a separable kernel, edge cells carried on beyond the edges."""
    reach = len(kernel) // 2
    taps = lambda o, n: [(F.least(F.lit(n - 1), F.greatest(F.lit(0), o + (i - reach))), F.lit(k)) for i, k in enumerate(kernel)]
    return stencilled(plane, by, size, size, taps, lambda x: (x - reach, x + reach))


def stencilled(plane: DataFrame, by: list[str], size: tuple[int, int], given: tuple[int, int], taps, span) -> DataFrame:
    """Each cell of a plane of ``size`` as a weighted sum of cells of one of ``given``.

    ``taps(o, n)`` lists, for an output coordinate, the input coordinates and their
    weights; ``span(x)`` bounds the output coordinates that an input bears on. The
    weights of an input cell are summed up where it stands.
    """
    out = plane
    for axis, (n, m) in zip(("h", "w"), zip(size, given, strict=True), strict=True):
        first, last = span(F.col(axis))
        reached = F.sequence(F.greatest(F.lit(0), first).cast("int"), F.least(F.lit(n - 1), last).cast("int"))
        weight = lambda o, axis=axis, m=m: sum((F.when(at == F.col(axis), k).otherwise(0.0) for at, k in taps(o, m)), F.lit(0.0))
        pairs = F.transform(reached, lambda o: F.struct(o.alias("o"), weight(o).alias("k")))  # noqa: B023
        out = out.withColumn(f"_{axis}", F.explode(pairs)).where(F.col(f"_{axis}.k") != 0)
    value = F.sum(F.col("v") * F.col("_h.k") * F.col("_w.k")).alias("v")
    return out.groupBy(*by, F.col("_h.o").cast("long").alias("h"), F.col("_w.o").cast("long").alias("w")).agg(value)


def center_pad(plane: DataFrame, by: list[str], size: tuple[int, int], target: tuple[int, int], value: float = 0.0) -> DataFrame:
    """A plane in the middle of one of ``target`` cells, ``value`` around it; the odd row or column goes to the end."""
    top, left = center_shift(size[0], target[0]), center_shift(size[1], target[1])
    if target[0] < size[0] or target[1] < size[1]:
        raise ValueError("the target must not be smaller")
    cells = plane.select(*by).distinct().withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(target[0] - 1)))).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(target[1] - 1))))
    inside = F.col("h").between(top, top + size[0] - 1) & F.col("w").between(left, left + size[1] - 1)
    around = cells.where(~inside).select(*by, F.col("h").cast("long"), F.col("w").cast("long"), F.lit(float(value)).alias("v"))
    return plane.select(*by, (F.col("h") + top).cast("long").alias("h"), (F.col("w") + left).cast("long").alias("w"), "v").unionAll(around)


def kept_parity(v: Column, keep: Column) -> Column:
    """A cell's value where ``keep`` holds, 0 elsewhere."""
    return F.when(keep, v).otherwise(0.0)


def ramp(low: float, high: float, steps: int, method: str = "linear") -> Column:
    """``steps`` values from ``low`` to ``high`` as an array, in equal steps of the value or of its logarithm."""
    if method not in ("linear", "log"):
        raise ValueError(f"no such method: {method}")
    a, b = (math.log(low), math.log(high)) if method == "log" else (float(low), float(high))
    step = (b - a) / max(1, steps - 1)
    at = lambda i: a + i * step
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.exp(at(i)) if method == "log" else at(i))
