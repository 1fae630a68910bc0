"""Temperature mixing of sources, realised as block permutations under a token budget.

A source's weight is its token share raised to an exponent and normalised. The
exponent is bisected between 1 (shares as they are) and 0 (all equal) until the
weights' entropy meets a target, or as near as the limit on repetitions lets it.
Each source is then read in passes, each pass a permutation of its documents of
its own, and every source's passes are laid evenly over blocks of the same
number of tokens, in which the documents are permuted again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, row_digest, sent_whole, text_or_empty

TARGET = 0.97  # of the largest entropy that so many sources can have
MAX_REPEATS = 3.0
BLOCK_TOKENS = 1 << 16
BUCKET_TOKENS = 1 << 14
HALVINGS = 5  # in one pass over the sources
PASSES = 6
BROADCAST_SOURCES = 1_000_000
NO_SOURCE = "\x00"
UNIT = ("doc_id", "source", "text")  # what tells a row


@dataclass(frozen=True)
class Mixture:
    exponent: float
    entropy: float
    normaliser: float  # sum of the shares' powers
    budget: float  # tokens
    total: float


def measured(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum of powers, entropy of the normalised powers) for each exponent, in one aggregation over the sources."""
    sums = []
    for k, a in enumerate(exponents):
        power = F.pow("share", F.lit(a))
        sums += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log("share")).alias(f"l{k}")]
    row = shares.agg(*sums).first()
    return [(row[f"z{k}"], math.log(row[f"z{k}"]) - a * row[f"l{k}"] / row[f"z{k}"]) for k, a in enumerate(exponents)]


def solve(sources: DataFrame, target: float, max_repeats: float, budget_tokens: float | None) -> Mixture | None:
    """The exponent for ``sources`` (source, source_tokens), and the budget.

    Without a given budget it is the smallest under which every source is read
    once at least: that of the largest source, so a document is never left out.
    """
    row = sources.agg(F.sum("source_tokens").alias("t"), F.count("*").alias("n"), F.min("source_tokens").alias("least"), F.max("source_tokens").alias("most")).first()
    total, n = float(row["t"] or 0), row["n"]
    if not n or total <= 0:
        return None
    shares = sources.select((F.col("source_tokens") / total).alias("share"))
    largest, smallest = row["most"] / total, row["least"] / total
    goal = target * math.log(n)

    def budget(exponent: float, z: float) -> float:
        return float(budget_tokens) if budget_tokens else row["most"] / (largest**exponent / z)

    def repeats(exponent: float, z: float) -> float:
        return budget(exponent, z) * smallest**exponent / z / row["least"]

    low, high = 0.0, 1.0  # the largest exponent that still meets the entropy
    for wanted in ("entropy", "repeats"):
        (z0, h0), (z1, h1) = measured(shares, [low, high])
        if wanted == "entropy":
            if h1 >= goal:
                low = high = 1.0
                break
        elif repeats(low, z0) <= max_repeats:
            high = low
            break
        elif repeats(high, z1) > max_repeats:
            low = high
            break
        for _ in range(PASSES):
            inner = [low + (high - low) * k / 2**HALVINGS for k in range(1, 2**HALVINGS)]
            at, step = measured(shares, inner), 2 ** (HALVINGS - 1)
            k = step
            for _ in range(HALVINGS):
                step //= 2
                z, h = at[k - 1]
                up = h >= goal if wanted == "entropy" else repeats(inner[k - 1], z) > max_repeats
                if not step:
                    break
                k += step if up else -step
            width = (high - low) / 2**HALVINGS
            low, high = (low + width * k, low + width * (k + 1)) if up else (low + width * (k - 1), low + width * k)
        exponent = low if wanted == "entropy" else high
        low, high = exponent, 1.0
    z, h = measured(shares, [low])[0]
    return Mixture(low, h, z, budget(low, z), total)


def mix(docs: DataFrame, target: float = TARGET, max_repeats: float = MAX_REPEATS, budget_tokens: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """(block, slot, doc_id, source, pass, tokens, row_key): one row for each reading of a document, in order of (block, slot).

    Tokens are words between white space; an empty or null text has none and is
    read with its source all the same. A null source is a source of its own.
    Rows that are the same in id, source and text are one unit and read together;
    ``row_key`` joins readings to rows (``row_key``). An empty table gives no
    rows. Where no source has a token, each document is read once. Other columns
    are not read.

    Running sums over a source are taken in two steps, over buckets of the
    permutation and within each, so the work of a source that holds most of the
    rows is spread over as many buckets as its tokens ask for. The table of sources
    is sent to every task under a bound, and readings are dealt out by bucket.
    """
    text = text_or_empty()
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rows = docs.select(row_digest(*UNIT).alias("row_key"), F.col("doc_id"), F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), words.cast("long").alias("words"))
    units = cut(rows.groupBy("row_key", "source").agg(F.min("doc_id").alias("doc_id"), F.sum("words").alias("tokens")))
    sources = units.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    # a source without a token weighs as one with a single token
    sources = cut(sources.withColumn("source_tokens", F.greatest("source_tokens", F.lit(1))))
    mixture = solve(sources, target, max_repeats, budget_tokens)
    if mixture is None:
        return units.select(F.lit(0).cast("long").alias("block"), F.lit(0).alias("slot"), "doc_id", named("source"), F.lit(0).alias("pass"), "tokens", "row_key")
    weight = F.pow(F.col("source_tokens") / mixture.total, F.lit(mixture.exponent)) / mixture.normaliser
    plan = sources.withColumn("granted", F.round(F.lit(mixture.budget) * weight, 3)).withColumn("passes", F.greatest(F.lit(1), F.ceil(F.round(F.col("granted") / F.col("source_tokens"), 6))).cast("int"))
    plan = plan.withColumn("buckets", F.ceil(F.col("source_tokens") / BUCKET_TOKENS))
    readings = units.join(sent_whole(cut(plan), BROADCAST_SOURCES), "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "pass", "row_key"), 11) / F.lit(float(1 << 53))
    readings = readings.withColumn("place", place).withColumn("bucket", F.floor(F.col("place") * F.col("buckets")))
    # each bucket by itself: a source's readings never come to one task
    readings = readings.repartition("source", "pass", "bucket")
    totals = readings.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    before = totals.withColumn("bucket_start", F.sum("bucket_tokens").over(W.partitionBy("source", "pass").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("bucket_tokens")).drop("bucket_tokens")
    inside = W.partitionBy("source", "pass", "bucket").orderBy("place", "row_key").rowsBetween(W.unboundedPreceding, 0)
    placed = readings.withColumn("within", F.sum("tokens").over(inside) - F.col("tokens")).join(before, ["source", "pass", "bucket"])
    at = F.col("pass") * F.col("source_tokens") + F.col("bucket_start") + F.col("within")
    placed = placed.withColumn("at", at).where((F.col("pass") == 0) & F.lit(budget_tokens is None) | (F.col("at") < F.col("granted")))
    n_blocks = max(1, math.ceil(mixture.budget / block_tokens))
    block = F.least(F.floor(F.col("at") / F.greatest("granted", "source_tokens") * n_blocks), F.lit(n_blocks - 1))
    order = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "pass", "row_key"), "row_key", "pass")
    return placed.withColumn("block", block).withColumn("slot", F.row_number().over(order) - 1).select("block", "slot", "doc_id", named("source"), "pass", "tokens", "row_key")


def named(source: str):
    return F.when(F.col(source) != NO_SOURCE, F.col(source)).alias(source)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mixture reads it, all columns kept."""
    readings = mix(docs, **options).select("row_key")
    keyed = docs.withColumn("_fl_row_key", row_digest(*UNIT))
    return keyed.join(readings, keyed["_fl_row_key"] == readings["row_key"]).select(*[keyed[c] for c in docs.columns])
