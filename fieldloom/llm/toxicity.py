"""Toxicity: boosted trees over dense features of a text, then isotonic calibration.

A lexicon is learned first: word beginnings and whole words, counted by a
grouped aggregation over labelled documents, kept where documents marked toxic
hold them far more often. The dense features are the densities of lexicon words
and their nearness to words of the second person, and the rates of capitals,
punctuation and obfuscated spellings. Gradient-boosted trees learn from them,
and an isotonic fit on labelled rows that the trees haven't seen maps their
margin to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

# Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinem deinen ihr euch euer eure tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
# Signs written in place of letters.
LOOKALIKE = str.maketrans("01345789@$!|+", "oieastbgasiit")
CORE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
INNER = re.compile(r"[\W_]+")
FEATURES = ("log_words", "hits", "hit_density", "weight_sum", "weight_density", "weight_max", "second_density", "nearness", "caps_rate", "caps_words", "punct_rate", "marks_rate", "obfuscated_rate", "digit_rate")
BEGINNINGS = (4, 5, 6)
SAMPLE_ROWS = 20_000
LEXICON_TERMS = 4_000


def plain_word(token: str) -> tuple[str, bool]:
    """The letters of a token in lower case with look-alike signs read as letters, and whether that changed a spelling."""
    core = CORE.sub("", token).lower()
    if core.isalpha():
        return core, False
    letters = sum(c.isalpha() for c in core)
    if not letters:
        return "", False
    word = INNER.sub("", core.translate(LOOKALIKE))
    inner = core.strip("@$!|+0123456789")
    return word, letters >= 2 and inner.isalpha() is False and inner != word


def terms(word: str) -> Iterable[str]:
    """A word's beginnings, and the word itself."""
    yield from (f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)
    if word:
        yield f"^{word}$"


def document_terms(text: str) -> set[str]:
    return {t for token in set(text.split()) for t in terms(plain_word(token)[0])}


@dataclass
class Lexicon:
    """Counts of labelled documents, toxic and not, for each kept term."""

    counts: dict[str, tuple[int, int]]
    toxic: int
    clean: int

    def weight(self, pos: int, neg: int, toxic: int, clean: int) -> float:
        """How much likelier toxic documents hold the term: a log ratio, drawn to 0 where few documents show it."""
        ratio = math.log((pos + 0.1) / (toxic + 1)) - math.log((neg + 0.1) / (clean + 1))
        return max(0.0, ratio) * pos / (pos + 1.0)

    def of_word(self, word: str, own: int | None = None) -> float:
        """The largest weight of a word's terms; with ``own``, as if the document with this label hadn't been counted."""
        best = 0.0
        for t in terms(word):
            if (c := self.counts.get(t)) is not None:
                pos, neg, toxic, clean = *c, self.toxic, self.clean
                if own is not None:
                    pos, toxic, neg, clean = (pos - 1, toxic - 1, neg, clean) if own else (pos, toxic, neg - 1, clean - 1)
                best = max(best, self.weight(max(pos, 0), max(neg, 0), toxic, clean))
        return best


HIT = 1.5


class Featurizer:
    """Dense features of whole texts; what a token contributes is worked out once."""

    def __init__(self, lexicon: Lexicon, keep: int = 300_000):
        self.lexicon, self.keep = lexicon, keep
        self.known: dict[tuple[str, int | None], tuple] = {}

    def of_token(self, token: str, own: int | None) -> tuple:
        if (found := self.known.get((token, own))) is None:
            if len(self.known) > self.keep:
                self.known.clear()
            word, obfuscated = plain_word(token)
            weight = self.lexicon.of_word(word, own)
            caps = sum(c.isupper() for c in token)
            punct = sum(not c.isalnum() for c in token)
            found = (weight, word in SECOND_PERSON, obfuscated, caps, caps >= 2 and caps == sum(c.isalpha() for c in token), punct, token.count("!") + token.count("?"), sum(c.isdigit() for c in token))
            self.known[token, own] = found
        return found

    def __call__(self, text: str, own: int | None = None) -> list[float]:
        tokens = text.split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        sums = [0.0] * 8
        hits, top, chars, marked = 0, 0.0, 0, set()
        for token, k in Counter(tokens).items():
            weight, second, obfuscated, caps, all_caps, punct, marks, digits = self.of_token(token, own)
            chars += k * len(token)
            if weight >= HIT:
                hits += k
                top = max(top, weight)
                sums[0] += k * weight
                marked.add(token)
            for i, x in enumerate((second, obfuscated, caps, all_caps, punct, marks, digits), 1):
                if x:
                    sums[i] += k * x
        near = 0.0
        if marked and sums[1]:
            you = np.array([i for i, t in enumerate(tokens) if self.of_token(t, own)[1]])
            at = np.array([i for i, t in enumerate(tokens) if t in marked])
            right = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(right, len(you) - 1)]), np.abs(at - you[np.maximum(right - 1, 0)]))
            near = float((1 / (1 + gap)).sum())
        return [math.log1p(n), float(hits), hits / n, sums[0], sums[0] / n, top, sums[1] / n, near, sums[3] / chars, sums[4] / n, sums[5] / chars, sums[6] / n, sums[2] / n, sums[7] / chars]


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel
    calibration: object


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def features(docs: DataFrame, lexicon: Lexicon, own: str | None = None) -> DataFrame:
    """``docs`` with its text replaced by an array of FEATURES; ``own`` names the label column to leave out of the counts."""
    keep = [c for c in docs.columns if c != "text"]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        featurize = Featurizer(lexicon)
        for frame in frames:
            labels = frame[own].astype(int).tolist() if own else [None] * len(frame)
            out = frame[keep].copy()
            out["features"] = [featurize(t, y) for t, y in zip(frame["text"], labels, strict=True)]
            yield out

    kinds = dict(docs.dtypes)
    return docs.mapInPandas(task, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "features array<double>"]))


def learn_lexicon(rows: DataFrame, most_terms: int) -> Lexicon:
    """Terms of labelled ``rows`` (text, toxic) that toxic documents hold more often, the strongest ``most_terms``."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                for t in document_terms(text):
                    counts.setdefault(t, [0, 0])[1 - int(toxic)] += 1
            yield pd.DataFrame({"term": list(counts), "pos": [c[0] for c in counts.values()], "neg": [c[1] for c in counts.values()]})

    total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    toxic, clean = int(total["p"]), int(total["n"]) - int(total["p"])
    counted = rows.select("text", "toxic").mapInPandas(task, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    gain = F.col("pos") * (F.log((F.col("pos") + 0.1) / (toxic + 1)) - F.log((F.col("neg") + 0.1) / (clean + 1)))
    best = counted.where("pos >= 2").withColumn("gain", gain).where("gain > 0").orderBy(F.desc("gain"), "term").limit(most_terms)
    return Lexicon({r["term"]: (r["pos"], r["neg"]) for r in best.collect()}, toxic, clean)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon_terms: int = LEXICON_TERMS, rounds: int = 12, depth: int = 3) -> Model | None:
    """A model from the labelled rows outside the held-out fold, at most about ``sample_rows`` of them (by hash of the id).

    Returns None when those rows don't show both labels.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(fold() != 0)
    counts = known.groupBy("toxic").count().collect()
    n = sum(r["count"] for r in counts)
    if len(counts) < 2:
        return None
    share = min(1.0, sample_rows / n)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = cut(docs.select("doc_id", text_or_empty().alias("text")).join(chosen, "doc_id"))
    lexicon = learn_lexicon(rows, lexicon_terms)
    prepared = cut(features(rows, lexicon, own="toxic").withColumn("part", fold()).withColumn("vector", array_to_vector("features")).drop("features").coalesce(4))
    trees = GBTClassifier(featuresCol="vector", labelCol="toxic", maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=2, seed=11).fit(prepared.where("part != 4"))
    shown = margins(prepared.where("part = 4"), trees).select("margin", F.col("toxic").cast("double").alias("label"))
    both = shown.select("label").distinct().count() == 2
    if not both:
        shown = margins(prepared, trees).select("margin", F.col("toxic").cast("double").alias("label"))
    # equal margins are one point of the fit, so that what reaches the driver is bounded by the trees' leaves
    points = shown.groupBy("margin").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(points)
    return Model(lexicon, trees, calibration)


def margins(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    return trees.transform(rows).withColumn("margin", F.round(vector_to_array("probability")[1], 9))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Whole texts are read; null texts are empty and get the score of a text
    without words. A null ``doc_id`` is held out. Repeated rows are scored each.
    Without a model, every score is 0. Other columns are not read. The score is
    the calibrated probability with a hundredth of the trees' own added, which
    keeps the order of rows within a step of the calibration.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    held = F.coalesce(fold() == 0, F.lit(True)).alias("held_out")
    if model is None:
        return rows.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shown = margins(features(rows, model.lexicon).withColumn("vector", array_to_vector("features")).drop("features"), model.trees)
    scored = model.calibration.transform(shown.select("doc_id", "margin"))
    mixed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * F.col("margin")))
    return scored.select("doc_id", held, mixed.alias("score"), (mixed >= 0.5).cast("int").alias("predicted"))
