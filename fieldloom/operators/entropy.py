"""Symbol statistics: histograms, quantised CDFs, bit costs, contexts, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept, sent_whole

MOST_RANGES = 200_000


def histogram(symbols: DataFrame, by: str) -> DataFrame:
    """(by, sym, cells, total, p): counts of each symbol within its stream."""
    counts = symbols.groupBy(by, "sym").agg(F.count("*").alias("cells"))
    totals = counts.groupBy(by).agg(F.sum("cells").alias("total"))
    return counts.join(totals, by).withColumn("p", F.col("cells") / F.col("total"))


def entropy(hist: DataFrame, by: str) -> DataFrame:
    """(by, total, bits, bits_per_symbol) of an ideal code."""
    cost = F.sum(F.col("cells") * -F.log2("p"))
    return hist.groupBy(by).agg(F.max("total").alias("total"), cost.alias("bits"), (cost / F.max("total")).alias("bits_per_symbol"))


def smoothed_cdf(hist: DataFrame, by: str, precision: int = 16) -> DataFrame:
    """(by, sym, lo, hi): integer ranges of symbols, each at least one wide, from 0 to 2^precision.

    Frequencies are scaled and rounded, at least 1; the last bound is forced, and a
    running minimum from the end keeps every range open. The window runs over the
    symbols of a stream, not its cells.
    """
    top = 1 << precision
    freq = F.greatest(F.lit(1), F.round(F.col("cells") * (float(top - 1) / F.col("total"))).cast("long"))
    up = W.partitionBy(by).orderBy("sym").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(by).orderBy(F.desc("sym")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(by)
    ranked = hist.withColumn("hi", F.sum(freq).over(up)).withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("sym"))).withColumn("n_syms", F.count("*").over(whole))
    forced = ranked.withColumn("hi", F.when(F.col("rank") == F.col("n_syms"), top).otherwise(F.col("hi")))
    # hi - rank must not fall towards the end: the running minimum of it, from the end
    fixed = forced.withColumn("hi", F.min(F.col("hi") - F.col("rank")).over(down) + F.col("rank"))
    return fixed.select(by, "sym", F.coalesce(F.lag("hi").over(W.partitionBy(by).orderBy("sym")), F.lit(0)).cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def prefix_sums(rows: DataFrame, by: str, order: str, value: str, width: int | None = None) -> DataFrame:
    """``rows`` with ``before`` and ``through``: exclusive and inclusive running sums over each group.

    With ``width``, where a group may hold a large part of all rows: ``order`` is a
    number, its stretches of that width are summed up first, and only their sums
    run over a whole group; the rows of a stretch are one task's.
    """
    if width is None:
        through = F.sum(value).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
        return rows.withColumn("through", through).withColumn("before", F.col("through") - F.col(value))
    dealt = rows.withColumn("_stretch", F.floor(F.col(order) / width))
    totals = dealt.groupBy(by, "_stretch").agg(F.sum(value).alias("_total"))
    first = totals.withColumn("_first", F.sum("_total").over(W.partitionBy(by).orderBy("_stretch").rowsBetween(W.unboundedPreceding, 0)) - F.col("_total")).drop("_total")
    inside = F.sum(value).over(W.partitionBy(by, "_stretch").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    out = dealt.withColumn("_inside", inside).join(first, [by, "_stretch"]).withColumn("through", F.col("_first") + F.col("_inside"))
    return out.withColumn("before", F.col("through") - F.col(value)).drop("_stretch", "_inside", "_first")


def differences(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The inverse of an inclusive running sum."""
    return rows.withColumn("step", F.col(value) - F.coalesce(F.lag(value).over(W.partitionBy(by).orderBy(order)), F.lit(0)))


def spatial_context(cells: DataFrame, mode: str, threshold: int) -> DataFrame:
    """``cells`` (n, h, w, sym and the column ``mode``) with ``ctx``: how many of the cells above and to the left lie off the mode."""
    off = lambda c: F.coalesce((F.abs(c - F.col(mode)) > threshold).cast("int"), F.lit(0))
    above = F.lag("sym").over(W.partitionBy("n", "w").orderBy("h"))
    left = F.lag("sym").over(W.partitionBy("n", "h").orderBy("w"))
    return cells.withColumn("ctx", off(above) + off(left))


def channel_context(cells: DataFrame, mode: str, threshold: int) -> DataFrame:
    """``cells`` (n, c, h, w, sym and the column ``mode``) with ``ctx``: how many of the cells above, to the left and in the channel before lie off their mode."""
    off = lambda c, m: F.coalesce((F.abs(c - m) > threshold).cast("int"), F.lit(0))
    lag = lambda c, over: F.lag(c).over(over)
    out = F.lit(0)
    for over in (W.partitionBy("n", "c", "w").orderBy("h"), W.partitionBy("n", "c", "h").orderBy("w"), W.partitionBy("n", "h", "w").orderBy("c")):
        out = out + off(lag("sym", over), lag(mode, over))
    return cells.withColumn("ctx", out)


def modes(symbols: DataFrame, by: str) -> DataFrame:
    """(by, mode): the most frequent symbol of each stream, the smallest of equals."""
    counts = symbols.groupBy(by, "sym").agg(F.count("*").alias("cells"))
    return counts.groupBy(by).agg(F.max_by("sym", F.struct("cells", -F.col("sym"))).alias("mode"))


def normal_quantile(p: float) -> float:
    """The value below which a standard normal law has the mass ``p``."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def lower_bounded(x: Column, bound: float) -> Column:
    return F.greatest(x, F.lit(float(bound)))


def non_negative(x: Column, least: float = 0.0, offset: float = 2.0**-18) -> Column:
    """A stored parameter's value, at least ``least``: the stored root is bounded, squared, and a pedestal taken off."""
    pedestal = offset * offset
    return lower_bounded(x, (least + pedestal) ** 0.5) ** 2 - pedestal


def stored_root(x: Column, offset: float = 2.0**-18) -> Column:
    """What is stored for a value that isn't negative; the inverse of ``non_negative``."""
    pedestal = offset * offset
    return F.sqrt(F.greatest(x + pedestal, F.lit(pedestal)))


def escape_bits(sym: Column, most: Column) -> Column:
    """Bits of a symbol outside 0..most: its zigzag code in groups of four bits, and the unary count of groups; 0 inside."""
    raw = F.when(sym < 0, -2 * sym - 1).when(sym >= most, 2 * (sym - most))
    groups = F.when(raw == 0, 0).otherwise(F.ceil(F.length(F.bin(raw)) / 4))
    return F.when(raw.isNull(), 0).otherwise(4 * groups + 4 * (F.floor(groups / 15) + 1)).cast("long")


def scale_table(low: float = 0.11, high: float = 256.0, levels: int = 64) -> list[float]:
    """Scales in equal steps of the logarithm."""
    import math

    step = (math.log(high) - math.log(low)) / (levels - 1)
    return [math.exp(math.log(low) + step * i) for i in range(levels)]


def scale_index(scale: Column, table: list[float], least: float = 0.11) -> Column:
    """The first entry of the table that is as large, or the last."""
    bounded = F.greatest(scale, F.lit(least))
    return F.size(F.filter(F.array(*[F.lit(s) for s in table[:-1]]), lambda s: s < bounded)).cast("long")


def erfc(x: Column) -> Column:
    """The complementary error function, to about 1.5e-7, by the usual fifth-degree fit."""
    # The fit's published coefficients.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + 0.3275911 * F.abs(x))
    fit = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4])))) * F.exp(-x * x)
    return F.when(x >= 0, fit).otherwise(2 - fit)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / F.lit(2.0**0.5))


def interval_likelihood(x: Column, mean: Column, scale: Column, least: float = 1e-9) -> Column:
    """The mass of a normal law on the unit interval around ``x``."""
    d = F.abs(x - mean)
    return F.greatest(normal_cdf((0.5 - d) / scale) - normal_cdf((-0.5 - d) / scale), F.lit(least))


def range_lookup(points: DataFrame, ranges: DataFrame, by: str, precision: int = 16, width: int = 256) -> DataFrame:
    """``points`` (by, cf, …) with the symbol whose range [lo, hi) holds ``cf``.

    Ranges are filed under every stretch of ``width`` that they touch, so the
    lookup is an equi-join on stream and stretch. Tables of ranges are small, and
    are sent to every task up to a counted bound, so that a stream that holds most
    of the points isn't one task.
    """
    ranges = sent_whole(kept(ranges), MOST_RANGES)
    filed = ranges.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    inside = (F.col("cf") >= F.col("lo")) & (F.col("cf") < F.col("hi"))
    return points.withColumn("stretch", F.floor(F.col("cf") / width)).join(filed, [by, "stretch"]).where(inside).drop("stretch")
