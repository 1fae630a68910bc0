"""Facts about raw video from file names and sizes, and frame lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part(name: Column, pattern: str) -> Column:
    found = F.regexp_extract(name, pattern, 1)
    return F.when(found != "", found)


def raw_video_info(name: Column) -> list[Column]:
    """width, height, fps, bits, chroma, order of a raw video's file name; 8 bits where none are named."""
    bits = part(name, r"(?i)(?<!\d)(\d{1,2})[ _-]?bits?")
    of_format = part(name, r"(?i)p(?:400|420|422|444)(\d{2})(?:[lb]e)?")
    both = bits.isNotNull() & of_format.isNotNull() & (bits.cast("int") != of_format.cast("int"))
    return [
        part(name, r"(\d+)x\d+").cast("int").alias("width"),
        part(name, r"\d+x(\d+)").cast("int").alias("height"),
        part(name, r"(?i)(\d+(?:\.\d+)?)(?:hz|fps)").cast("double").alias("fps"),
        F.when(both, F.raise_error(F.concat(F.lit("two bit depths in "), name))).otherwise(F.coalesce(bits, of_format, F.lit("8")).cast("int")).alias("bits"),
        part(name, r"(?i)(?:p|yuv)(400|420|422|444)").alias("chroma"),
        F.lower(part(name, r"(?i)[0-9]([lb]e)(?![a-z])")).alias("order"),
    ]


def plane_sizes(width: Column, height: Column, chroma: Column) -> tuple[Column, Column]:
    """Cells of the luma plane and of one chroma plane, halves rounded up."""
    across = F.when(chroma.isin("420", "422"), F.ceil(width / 2)).otherwise(width)
    down = F.when(chroma == "420", F.ceil(height / 2)).otherwise(height)
    return width * height, F.when(chroma == "400", F.lit(0)).otherwise(across * down)


def frame_count(size: Column, width: Column, height: Column, chroma: Column, bits: Column) -> Column:
    """Whole frames in a file; null where a frame has no size."""
    luma, one = plane_sizes(width, height, chroma)
    per = (luma + 2 * one) * F.when(bits > 8, 2).otherwise(1)
    return F.floor(F.try_divide(size, per)).cast("long")


def frame_paths(lists: DataFrame, frames: int) -> DataFrame:
    """(clip, frame, path): the frames of each named clip; blank lines are left out."""
    clips = lists.select(F.trim("clip").alias("clip")).where("clip != ''")
    return clips.withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(frames)))).withColumn("path", F.concat(F.col("clip"), F.lit("/im"), F.col("frame").cast("string"), F.lit(".png")))
