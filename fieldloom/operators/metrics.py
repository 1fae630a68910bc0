"""Distortion, rate and throughput, over rows that pair an original ``v`` with its reconstruction ``r``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def db(x: Column) -> Column:
    """Ten times the decimal logarithm; null where ``x`` is 0."""
    return 10 * F.log10(F.nullif(x, F.lit(0.0)))


def slice_errors(pairs: DataFrame) -> DataFrame:
    """(n, mse, rmse, span, nrmse, maxe) per slice; ``nrmse`` is null on a constant slice."""
    d = F.col("r") - F.col("v")
    per = pairs.groupBy("n").agg(F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("maxe"), (F.max("v") - F.min("v")).alias("span"))
    return per.withColumn("rmse", F.sqrt("mse")).withColumn("nrmse", F.try_divide(F.col("rmse"), F.col("span")))


def science_metrics(pairs: DataFrame) -> DataFrame:
    """One row: mean rmse and nrmse of the slices, the largest error, PSNR from the root mean square of the nrmse."""
    return slice_errors(pairs).agg(
        F.avg("rmse").alias("rmse"), F.avg("nrmse").alias("nrmse"), F.max("maxe").alias("maxe"), (-db(F.avg(F.col("nrmse") * F.col("nrmse")))).alias("psnr"), F.count("*").alias("slices")
    )


def psnr_8bit(pairs: DataFrame) -> DataFrame:
    """(n, mse, psnr) of values in 0..1 brought to 8 bits; null where nothing differs."""
    level = lambda c: F.rint(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * 255)
    d = level("v") - level("r")
    return pairs.groupBy("n").agg(F.avg(d * d).alias("mse")).withColumn("psnr", db(F.lit(255.0 * 255.0) / F.nullif(F.col("mse"), F.lit(0.0))))


def sequence_psnr(frames: DataFrame, peak: float = 1.0) -> DataFrame:
    """(seq, frames, mean_of_psnr, psnr_of_mean) from (seq, frame, mse): the two conventions side by side."""
    of = lambda mse: db(F.lit(peak * peak) / F.nullif(mse, F.lit(0.0)))
    return frames.groupBy("seq").agg(F.count("*").alias("frames"), F.avg(of(F.col("mse"))).alias("mean_of_psnr"), of(F.avg("mse")).alias("psnr_of_mean"))


def yuv_psnr(planes: DataFrame) -> DataFrame:
    """(seq, frame, psnr_y, psnr_u, psnr_v, psnr_yuv) from (seq, frame, plane, psnr), luma weighing four of six."""
    of = lambda p: F.max(F.when(F.col("plane") == p, F.col("psnr")))
    wide = planes.groupBy("seq", "frame").agg(of("y").alias("psnr_y"), of("u").alias("psnr_u"), of("v").alias("psnr_v"))
    return wide.withColumn("psnr_yuv", (4 * F.col("psnr_y") + F.col("psnr_u") + F.col("psnr_v")) / 6)


def residual_stats(pairs: DataFrame, by: str) -> DataFrame:
    """Moments of the residual by group; sample deviation, interpolated median."""
    d = F.col("v") - F.col("r")
    return pairs.withColumn("d", d).groupBy(by).agg(
        F.min("d").alias("dmin"), F.max("d").alias("dmax"), F.avg("d").alias("dmean"), F.stddev_samp("d").alias("dstd"), F.avg(F.abs("d")).alias("dabs"), F.max(F.abs("d")).alias("dabsmax"), F.median("d").alias("dmedian"), F.avg(F.col("d") * F.col("d")).alias("dmse")
    )


def residual_histogram(pairs: DataFrame, low: float, high: float, bins: int = 100) -> DataFrame:
    """(bin, cells): equal bins over [low, high], the last closed; values outside are in bins 0 and bins + 1."""
    d = F.col("v") - F.col("r")
    bin_ = F.when(d < low, 0).when(d > high, bins + 1).when(d == high, bins).otherwise(F.floor((d - low) / ((high - low) / bins)) + 1)
    return pairs.select(bin_.cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("cells"))


def rate_rollup(streams: DataFrame, per: Column) -> DataFrame:
    """(name, bits, bpp) from likelihoods (name, p), and the total under a null name; ``per``: cells in all."""
    return streams.rollup("name").agg(F.sum(-F.log2("p")).alias("bits")).withColumn("bpp", F.col("bits") / per)


def rd_loss(mse: Column, bpp: Column, weight: float) -> Column:
    return weight * 255.0**2 * mse + bpp


def bits_per_cell(size: Column, cells: Column) -> Column:
    return F.try_divide(size * 8.0, cells)


def gib_per_second(size: Column, seconds: Column) -> Column:
    return F.try_divide(size / float(1024**3), seconds)


def kbps(size: Column, frames: Column, fps: Column) -> Column:
    return F.try_divide(size * 8.0 * fps, frames * 1000.0)


def serial_rate(a: Column, b: Column) -> Column:
    """The rate of two steps one after the other."""
    return F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
