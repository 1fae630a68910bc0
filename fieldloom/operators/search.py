"""Choosing rows: targets, ranks, samples, remapping, audits between result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def closest(sweep: DataFrame, by: str, setting: str, metric: str, target: float) -> DataFrame:
    """(by, setting, metric): the setting whose metric is nearest to the target, the smallest of equals."""
    return sweep.groupBy(by).agg(F.min_by(F.struct(setting, metric), F.struct(F.abs(F.col(metric) - target), setting)).alias("best")).select(by, f"best.{setting}", f"best.{metric}")


def top_k(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def every_kth(rows: DataFrame, by: str, order: str, step: int, most: int) -> DataFrame:
    """Of each group every ``step``th row, the first ``most`` of these, numbered by ``pick``."""
    place = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    picked = rows.withColumn("_place", place).where(F.col("_place") % step == 0).withColumn("pick", F.floor(F.col("_place") / step).cast("long"))
    return picked.where(F.col("pick") < most).drop("_place")


def keyed(key: str, seed: int) -> Column:
    """32 bits of a keyed hash, as a number that other engines make alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")


def hash_sample(rows: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    """Rows whose keyed hash lies below ``share``: the same rows at every run, with nothing exchanged."""
    return rows.where(keyed(key, seed) < int(share * (1 << 32)))


def permuted(rows: DataFrame, by: str, key: str, seed: int = 1) -> DataFrame:
    """``rows`` with ``place``: a permutation of each group by keyed hash, ties by the key itself."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(keyed(key, seed), key)) - 1)


def random_sample(rows: DataFrame, by: str, key: str, m: int, seed: int = 1) -> DataFrame:
    """Exactly ``m`` rows of each group, ``draw`` 0 to m - 1: the first of a permutation, which begins anew where the group ends.

    Keys that repeat in a group are one row.
    """
    placed = permuted(rows.dropDuplicates([by, key]), by, key, seed).where(F.col("place") < m)
    sizes = placed.groupBy(by).agg(F.count("*").alias("_size"))
    draws = F.sequence(F.col("place"), F.lit(m - 1), F.col("_size").cast("int"))
    return placed.join(sizes, by).withColumn("draw", F.explode(draws)).drop("place", "_size")


def quota(rows: DataFrame, by: str, order: str, quotas: DataFrame, number: str) -> DataFrame:
    """Of each group the first rows, as many as ``quotas`` (by, number) grants it, rounded to the nearest even; groups without one give none."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(order)))
    return ranked.join(quotas.select(by, number), by).where(F.col("rank") <= F.rint(number)).drop(number)


def repeated(rows: DataFrame, by: str, key: str, m: int, seed: int = 1) -> DataFrame:
    """``m`` rows of each group of fewer: all of it as often as it goes into ``m``, and for the rest the first of a permutation; ``copy`` numbers a row's readings."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("_size"))
    placed = permuted(rows, by, key, seed).join(sizes, by)
    times = F.floor(F.lit(m) / F.col("_size")) + (F.col("place") < m % F.col("_size")).cast("int")
    return placed.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0), (times - 1).cast("int"))).otherwise(F.array().cast("array<int>")))).drop("place", "_size")


def bisected(rows: DataFrame, low: float, high: float, value, target: str, steps: int = 40) -> DataFrame:
    """``rows`` with ``root``: where the rising function ``value(x)`` meets the column ``target``, all rows at once, by halving [low, high] ``steps`` times inside one expression."""
    state = F.struct(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        below = value(mid) < F.col(target)
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, halve)
    return rows.withColumn("_found", found).withColumn("root", (F.col("_found.lo") + F.col("_found.hi")) / 2).drop("_found")


def closest_by_bisection(sweep: DataFrame, by: str, setting: str, metric: str, target: float) -> DataFrame:
    """(by, setting, metric): the best of the settings that a bisection over a monotone metric looks at.

    The sweep is there already, so what halving would look at is read from a map of
    each group; a group's settings are few.
    """
    groups = sweep.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(setting, metric))).alias("_m"), F.min(setting).alias("_lo"), F.max(setting).alias("_hi"), F.min_by(metric, setting).alias("_first"), F.max_by(metric, setting).alias("_last"))
    rises = F.col("_last") >= F.col("_first")
    none = F.lit(None).cast("double")
    state = F.struct(F.col("_lo").cast("long").alias("lo"), F.col("_hi").cast("long").alias("hi"), F.lit(None).cast("long").alias("best"), none.alias("gap"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2)
        told = F.element_at(F.col("_m"), mid.cast(dict(sweep.dtypes)[setting]))
        gap, open_ = F.abs(told - target), s["lo"] <= s["hi"]
        better = open_ & (s["gap"].isNull() | (gap < s["gap"]))
        up = (told < target) == rises
        return F.struct(
            F.when(open_ & up, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(open_ & ~up, mid - 1).otherwise(s["hi"]).alias("hi"),
            F.when(better, mid).otherwise(s["best"]).alias("best"),
            F.when(better, gap).otherwise(s["gap"]).alias("gap"),
        )

    looked = groups.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(64)), state, halve))
    best = F.col("_s.best").cast(dict(sweep.dtypes)[setting])
    return looked.select(by, best.alias(setting), F.element_at("_m", best).alias(metric))


def greedy_order(costs: DataFrame, parts: list[int]) -> list[int]:
    """An order of ``parts`` by greed over ``costs`` (part, given, bits): first the one that is cheapest by itself (``given`` null), then always the one that costs least beside its best helper among those before.

    The cost table is aggregated, with a row for each pair of parts; only its
    smallest row comes to the driver at each step.
    """
    order: list[int] = []
    while len(order) < len(parts):
        rest = [p for p in parts if p not in order]
        able = costs.where(F.col("part").isin(rest) & (F.col("given").isNull() | F.col("given").isin(order or [-1])))
        best = able.groupBy("part").agg(F.min("bits").alias("bits")).orderBy("bits", "part").first()
        order.append(best["part"] if best else min(rest))
    return order


def remapped(rows: DataFrame, key: str, table: DataFrame, to: str) -> DataFrame:
    """``rows`` with ``key`` looked up in ``table`` (key, to); a key that the table lacks raises."""
    found = rows.join(table.withColumn("_known", F.lit(True)), key, "left")
    return found.withColumn(to, F.when(F.col("_known"), F.col(to)).otherwise(F.raise_error(F.concat(F.lit("unknown key: "), F.col(key).cast("string"))))).drop("_known")


def in_range(value: Column, low: float, high: float, what: str) -> Column:
    """``value``, which must lie in [low, high]; null passes, other values raise."""
    told = F.concat(F.lit(f"{what} must lie in [{low}, {high}]: "), value.cast("string"))
    return F.when(value.isNull() | value.between(low, high), value).otherwise(F.raise_error(told))


def missing(wanted: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What is still to do."""
    return wanted.join(done.select(*on), on, "left_anti")


def audit(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on…, side): keys of either table, and whether both hold them."""
    left, right = a.select(*on).distinct().withColumn("_a", F.lit(1)), b.select(*on).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return left.join(right, on, "full_outer").select(*on, side.alias("side"))


def renamed_key(name: Column, rules: list[tuple[str, str]]) -> Column:
    """A name after a chain of pattern rules."""
    for pattern, to in rules:
        name = F.regexp_replace(name, pattern, to)
    return name


def resampled(rows: DataFrame, by: str, order: str, m: int) -> DataFrame:
    """Exactly m rows of each group: in order, beginning anew where the group ends."""
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(by).orderBy(order)) - 1)
    sizes = rows.groupBy(by).agg(F.count("*").alias("_size"))
    places = F.sequence(F.lit(0), F.lit(m - 1))
    copies = F.filter(places, lambda i: F.pmod(i, F.col("_size")) == F.col("_rank"))
    return ranked.join(sizes, by).withColumn("place", F.explode(copies)).drop("_rank", "_size")
