"""Groups of three slices, overlapped tiles and their fusion, padding, cropping, parity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_by_three(field: DataFrame, h: int, w: int, slices: int, pad: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, g, c, h, w, v): slices in groups of three, the last group filled with ``pad``; ``by`` tells fields apart."""
    real = field.select(*by, (F.floor(F.col("n") / 3)).cast("long").alias("g"), (F.col("n") % 3).cast("long").alias("c"), "h", "w", "v")
    missing = list(range(slices, 3 * math.ceil(slices / 3)))
    if not missing:
        return real
    kinds = dict(real.dtypes)
    places = F.array(*[F.struct(F.lit(n // 3).cast("long").alias("g"), F.lit(n % 3).cast("long").alias("c")) for n in missing])
    fill = field.select(*by).distinct() if by else field.sparkSession.range(1)
    fill = fill.withColumn("_m", F.explode(places)).select(*by, "_m.g", "_m.c")
    cells = fill.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    return real.unionByName(cells.select(*by, "g", "c", F.col("h").cast(kinds["h"]).alias("h"), F.col("w").cast(kinds["w"]).alias("w"), F.lit(float(pad)).alias("v")))


def real_slices(groups: DataFrame, slices: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, n, h, w, v): groups of three back to slices, the filled ones left out."""
    n = F.col("g") * 3 + F.col("c")
    return groups.where(n < slices).select(*by, n.alias("n"), "h", "w", "v")


def tile_count(size: int, block: int, stride: int) -> int:
    """Tiles along one axis."""
    if not 0 < stride < block:
        raise ValueError("the stride must lie between 0 and the block's size")
    return math.ceil((size - block) / stride) + 1 if size > block else 1


def tiles_of(x: Column, size: int, block: int, stride: int) -> Column:
    """The numbers of the tiles that hold a coordinate."""
    last = tile_count(size, block, stride) - 1
    return F.sequence(F.greatest(F.lit(0), F.ceil((x - block + 1) / F.lit(float(stride)))).cast("int"), F.least(F.lit(last), F.floor(x / stride)).cast("int"))


def overlapped_tiles(field: DataFrame, size: tuple[int, int], block: tuple[int, int], stride: tuple[int, int]) -> DataFrame:
    """``field`` (…, h, w, v) with th, tw, dh, dw: each cell once for every tile that holds it; nothing is exchanged."""
    keep = [c for c in field.columns if c not in ("h", "w")]
    out = field.withColumn("th", F.explode(tiles_of(F.col("h"), size[0], block[0], stride[0]))).withColumn("tw", F.explode(tiles_of(F.col("w"), size[1], block[1], stride[1])))
    return out.select(*keep, "h", "w", "th", "tw", (F.col("h") - F.col("th") * stride[0]).alias("dh"), (F.col("w") - F.col("tw") * stride[1]).alias("dw"))


def hann(i: Column, length: int) -> Column:
    """A symmetric window's weight at ``i``."""
    return 0.5 * (1 - F.cos(2 * math.pi * i / F.lit(float(max(length - 1, 1)))))


def tile_weight(block: tuple[int, int], least: float = 1e-6) -> Column:
    return F.greatest(hann(F.col("dh"), block[0]) * hann(F.col("dw"), block[1]), F.lit(least))


def overlap_add(tiles: DataFrame, by: list[str], block: tuple[int, int]) -> DataFrame:
    """The weighted mean of all tiles at each cell of (by…, h, w)."""
    weight = tile_weight(block)
    return tiles.groupBy(*by, "h", "w").agg((F.sum(F.col("v") * weight) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("v"))


def overwrite(tiles: DataFrame, by: list[str]) -> DataFrame:
    """At each cell the value of the last tile in row-major order."""
    return tiles.groupBy(*by, "h", "w").agg(F.max_by("v", F.struct("th", "tw")).alias("v"))


def cut_and_pad(field: DataFrame, size: tuple[int, int], block: tuple[int, int], share: float) -> DataFrame:
    """Tiles without overlap of ``share`` of a block, each shifted to the block's middle: th, tw, dh, dw."""
    if not 0 < share <= 1:
        raise ValueError("the share must lie in (0, 1]")
    for axis, (n, b) in enumerate(zip(size, block, strict=True)):
        x, real = ("h", "w")[axis], max(1, math.ceil(b * share))
        tile = F.floor(F.col(x) / real).cast("long")
        own = F.least(F.lit(real), F.lit(n) - tile * real)
        field = field.withColumn("t" + x, tile).withColumn("d" + x, F.col(x) - tile * real + F.floor((F.lit(b) - own) / 2))
    return field


def center_shift(size: int, target: int) -> int:
    """Where a centred axis of ``size`` begins in one of ``target``; negative: cells cropped before."""
    return (target - size) // 2 if target >= size else -((size - target) // 2)


def center_crop(field: DataFrame, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    top, left = -center_shift(size[0], target[0]), -center_shift(size[1], target[1])
    inside = (F.col("h") >= top) & (F.col("h") < top + target[0]) & (F.col("w") >= left) & (F.col("w") < left + target[1])
    return field.where(inside).withColumn("h", F.col("h") - top).withColumn("w", F.col("w") - left)


def padding_plan(sizes: DataFrame, multiple: int) -> DataFrame:
    """(…, left, right, top, bottom) that bring (h, w) to the next multiple, centred."""
    out = sizes
    for x, before, after in (("w", "left", "right"), ("h", "top", "bottom")):
        more = F.ceil(F.col(x) / multiple) * multiple - F.col(x)
        out = out.withColumn(before, F.floor(more / 2).cast("long")).withColumn(after, (more - F.floor(more / 2)).cast("long"))
    return out


def parity(anchor: int = 0) -> Column:
    """Whether a cell is an anchor of the checkerboard."""
    return (F.col("h") + F.col("w")) % 2 == anchor


def checkerboard_split(field: DataFrame, anchor: int = 0) -> tuple[DataFrame, DataFrame]:
    """Anchors and the rest, each packed to half the width."""
    half = F.floor(F.col("w") / 2).cast("long")
    return field.where(parity(anchor)).withColumn("w", half), field.where(~parity(anchor)).withColumn("w", half)


def checkerboard_merge(anchors: DataFrame, rest: DataFrame, anchor: int = 0) -> DataFrame:
    """The inverse of ``checkerboard_split``."""
    even = F.pmod(F.col("h") + anchor, F.lit(2))
    return anchors.withColumn("w", F.col("w") * 2 + even).unionByName(rest.withColumn("w", F.col("w") * 2 + 1 - even))


def average_pool(field: DataFrame, by: list[str], size: tuple[int, int]) -> DataFrame:
    """Means over two by two cells; an odd last row or column is left out."""
    inside = (F.col("h") < size[0] // 2 * 2) & (F.col("w") < size[1] // 2 * 2)
    return field.where(inside).groupBy(*by, F.floor(F.col("h") / 2).cast("long").alias("h"), F.floor(F.col("w") / 2).cast("long").alias("w")).agg(F.avg("v").alias("v"))


def interleaved(c: Column, channels: int, groups: int) -> Column:
    """A channel's place after the channels of all groups are dealt in turn."""
    per = channels // groups
    return (c % per) * groups + F.floor(c / per)
