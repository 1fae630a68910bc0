"""Language identification by fusing evidence: the text, the declared language, the address, the host.

Bayes' rule adds four log terms for each language. The text's comes from letter
trigrams learned on labelled documents. A declared markup language and the
address (a country's suffix, or a language in the path) count by their
reliability. The host's prior is the sum of the text posteriors of its other
rows, by one grouped aggregation, smoothed towards its registered domain's prior,
which is smoothed towards the prior of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, small_batches, text_or_empty

BUCKETS = 1 << 16
SAMPLE_ROWS = 4_000
LANGUAGES = 200
NONE = "und"
STRENGTH = 60.0  # letter trigrams overlap; this many say all that a text can say
MARKUP_RELIABILITY = 0.9
ADDRESS_RELIABILITY = 0.8
HOST_WEIGHT = DOMAIN_WEIGHT = 8.0  # rows that the level above counts as
ACCEPT = 0.5
# Country suffixes of addresses and the language that they speak for.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv", "tr": "tr"}


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of a text in lower case; a run of other signs is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(letters()[codes], codes, np.uint32(32))
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))] if len(codes) else codes
    if not len(codes) or (codes == 32).all():
        return np.zeros(0, dtype=np.int64)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return ((mixed * np.uint64(0x27D4EB2F) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]  # and NONE last
    log_p: np.ndarray  # BUCKETS x languages

    def evidence(self, text: str) -> tuple[list[float], int]:
        """Log likelihoods, of a strength that a text of any length keeps within bounds, and the count of trigrams."""
        at = trigrams(text)
        if not len(at):
            return [0.0] * len(self.languages), 0
        return (self.log_p[at].mean(axis=0) * min(float(len(at)), STRENGTH)).tolist(), len(at)


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """A model from at most about ``sample_rows`` labelled rows (text, lang), by hash of the text; whole texts are read.

    The LANGUAGES labels with the most rows are learned. Without labelled rows
    the model knows no language, and every text is NONE.
    """
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    total = sum(r["count"] for r in counts)
    names = sorted(r["lang"] for r in counts)
    if not names:
        return TextModel([NONE], np.zeros((BUCKETS, 1), dtype=np.float32))
    # as many rows of each label, so that rare languages are learned too
    each = sample_rows / len(names)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, each / r["count"])))])
    chosen = known.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_000)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * 1_000_000)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                counted.setdefault(lang, np.zeros(BUCKETS, np.int64))
                np.add.at(counted[lang], trigrams(text), 1)
        for lang, c in counted.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    table = np.zeros((BUCKETS, len(names)))
    sums = chosen.mapInPandas(task, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")) if total else None
    for r in packed.collect():
        table[np.array(r["b"]), names.index(r["lang"])] = r["n"]
    log_p = np.log(table + 0.05) - np.log(table.sum(axis=0) + 0.05 * BUCKETS)
    nothing = np.full((BUCKETS, 1), -math.log(BUCKETS) + 1.0)  # other scripts and noise
    return TextModel([*names, NONE], np.concatenate([log_p, nothing], axis=1).astype(np.float32))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def declared_by(html: Column) -> Column:
    """The two-letter language that a page's first html tag declares, or null."""
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def address_language(url: Column) -> Column:
    """The language in the first part of the path, or else that of the country's suffix, or null."""
    in_path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]+://[^/]+/([a-z]{2})(?:[/?#-]|$)", 1)
    suffix = F.regexp_extract(host_of(url), r"\.([a-z]{2})$", 1)
    table = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return F.coalesce(F.when(in_path != "", in_path), table[suffix])


def visible(html: Column) -> Column:
    """A page without scripts, styles and tags, for its letters only."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?\w+;", " ")


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a name without dots is its own domain."""
    return F.substring_index(host, ".", -2)


def identify(rows: DataFrame, model: TextModel, markup_reliability: float = MARKUP_RELIABILITY, address_reliability: float = ADDRESS_RELIABILITY, accept: float = ACCEPT) -> DataFrame:
    """(key columns, language, confidence, accepted), one for each row of ``rows`` (text, host, markup, address and any key columns).

    Text is read whole; without a letter, in a script that no label has, or
    without a language above ``accept``, the language is NONE and the row isn't
    accepted. Null text is empty; null markup or address is no evidence; a null
    host is a host of its own. Keys are passed on and not looked at, so they may
    be null or repeat; ones named as a column of the result give way to it. An empty table gives no rows.

    Only the evidence, not the text, is exchanged. Sums by host are combined
    before the exchange; the join with a host's prior is a plain equi-join, which
    adaptive execution splits where a host holds many rows.
    """
    with small_batches(rows.sparkSession):
        return fused_evidence(rows, model, markup_reliability, address_reliability, accept)


def fused_evidence(rows: DataFrame, model: TextModel, markup_reliability: float, address_reliability: float, accept: float) -> DataFrame:
    names = model.languages
    keys = [c for c in rows.columns if c not in ("text", "host", "markup", "address", "language", "confidence", "accepted")]
    k = len(names) - 1

    @F.pandas_udf("struct<ll: array<double>, n: int>")
    def evidence(texts: pd.Series) -> pd.DataFrame:
        got = [model.evidence(t) for t in texts]
        return pd.DataFrame({"ll": [g[0] for g in got], "n": [g[1] for g in got]})

    base = rows.select(F.struct(*keys).alias("_fl_keys"), F.coalesce("host", F.lit("")).alias("host"), "markup", "address", evidence(text_or_empty()).alias("e"))
    base = cut(base.select("_fl_keys", "host", "markup", "address", F.col("e.ll").alias("ll"), F.col("e.n").alias("n")))
    if not k:
        return base.select("_fl_keys.*", F.lit(NONE).alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))

    def normalised(scores: Column) -> Column:
        total = lambda ps: F.aggregate(ps, F.lit(0.0), lambda a, b: a + b)
        shared = lambda ps: let(total(ps), lambda t: F.transform(ps, lambda p: p / t))
        return let(scores, lambda s: let(F.array_max(s), lambda m: let(F.transform(s, lambda x: F.exp(x - m)), shared)))

    own = base.withColumn("p", F.when(F.col("n") > 0, normalised(F.col("ll"))).otherwise(F.array(*[F.lit(0.0)] * (k + 1))))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    hosts = cut(own.groupBy("host").agg(*sums))
    everywhere = hosts.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).first()
    mass = sum((everywhere[f"s{i}"] or 0.0) + 1.0 for i in range(k))
    root = [((everywhere[f"s{i}"] or 0.0) + 1.0) / mass for i in range(k)]
    domains = hosts.groupBy(domain_of(F.col("host")).alias("domain")).agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in range(k)])
    priors = hosts.withColumn("domain", domain_of(F.col("host"))).join(domains, "domain").select("host", F.array(*[f"s{i}" for i in range(k)]).alias("hs"), F.array(*[f"d{i}" for i in range(k)]).alias("ds"))
    fused = own.join(priors, "host")
    # without the row's own share, so that its text isn't counted twice
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    rest = lambda xs: F.transform(xs, lambda x, i: F.greatest(F.lit(0.0), x - F.get("p", i)))
    fused = fused.withColumn("hs", rest(F.col("hs"))).withColumn("ds", rest(F.col("ds")))
    fused = fused.withColumn("hn", total(F.col("hs"))).withColumn("dn", total(F.col("ds")))
    root_p = F.array(*[F.lit(p) for p in root])
    domain_p = F.transform("ds", lambda d, i: (d + DOMAIN_WEIGHT * F.get(root_p, i)) / (F.col("dn") + DOMAIN_WEIGHT))
    fused = fused.withColumn("dp", domain_p)
    host_p = F.transform("hs", lambda h, i: (h + HOST_WEIGHT * F.get("dp", i)) / (F.col("hn") + HOST_WEIGHT))
    fused = fused.withColumn("hp", host_p)
    tongue = F.array(*[F.lit(x) for x in names[:k]])

    def declared(column: str, reliability: float, i: Column) -> Column:
        other = math.log((1 - reliability) / max(1, k - 1)) if k > 1 else math.log(reliability)
        says = F.col(column).isNotNull() & F.array_contains(tongue, F.col(column))
        return F.when(says, F.when(F.get(tongue, i) == F.col(column), math.log(reliability)).otherwise(other)).otherwise(0.0)

    scores = F.transform("hp", lambda p, i: F.log(p * 0.98) + F.get("ll", i) + declared("markup", markup_reliability, i) + declared("address", address_reliability, i))
    # a text in no language may declare any of them alike
    unsaid = [F.when(F.array_contains(tongue, F.col(c)), -math.log(k)).otherwise(0.0) for c in ("markup", "address")]
    none = F.lit(math.log(0.02)) + F.get("ll", F.lit(k)) + sum((F.coalesce(u, F.lit(0.0)) for u in unsaid), F.lit(0.0))
    spoken = F.array(*[F.lit(x) for x in names])
    judged = lambda post: let(F.array_max(post), lambda best: F.struct(best.alias("p"), F.get(spoken, F.array_position(post, best).cast("int") - 1).alias("name")))
    # kept here, so that what a reader filters on isn't worked out again for each use
    found = cut(fused.select("_fl_keys", "n", let(normalised(F.concat(scores, F.array(none))), judged).alias("best")))
    language = F.when((F.col("n") > 0) & (F.col("best.p") >= accept), F.col("best.name")).otherwise(F.lit(NONE))
    return found.select("_fl_keys.*", language.alias("language"), F.round(F.when(F.col("n") > 0, F.col("best.p")).otherwise(0.0), 6).alias("confidence"), (language != NONE).alias("accepted"))
