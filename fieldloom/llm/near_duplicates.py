"""Near-duplicate documents from bottom-k sketches.

A document's set is its distinct word shingles, hashed to 64 bits by one
function; the k smallest hashes are its sketch. Documents with equal sets are one
class. Two classes with a similarity of at least the threshold share all but a
bounded part of their sketches, so each class is filed only under its rarest
retained values, as many as that part allows plus one: some list then holds
both. Rows of lists carry marks, a few bits that bound how far two sketches are
apart, as lists grow with the corpus and most classes that meet aren't alike:
only pairs that size and marks allow leave a list. Short lists give all of these.
A long list first lets go of the classes that no other of its classes may be
linked to, and where it is still long, every class is paired with the list's
pivot only, the class whose retained values are the most common; the
classes that aren't linked to their pivot are then compared with the pivot's
other classes block by block, inside tasks that return links and no pairs. A
pair's similarity is estimated on the union of the sketches, and where the
estimate leaves it open, the link is confirmed on the full sets. Components of
the links give each document its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, dropped, joined_evenly, sent_whole, shuffles_let_go, small_batches, text_or_empty, written

K = 64
SHORT_LIST = 24
MOST_COMPARED = 1 << 13  # rows of a long list whose marks are all compared
MARKS = ("m0", "m1", "m2", "m3")  # 64 bits each
BLOCK = 256
BROADCAST_IDS = 1_000_000
TASK_LINKS = 1 << 14
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 1 << 16


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for positions within a step."""
    up, down = np.ones(STEP + 1, dtype=np.uint64), np.ones(STEP + 1, dtype=np.uint64)
    up[1:], down[1:] = np.uint64(BASE), np.uint64(INVERSE)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, in order: words are runs of signs other than white space, A-Z read as a-z."""
    raw = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers()
    if len(raw) <= STEP:
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        return mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    out, at = [], 0
    while at < len(first):  # words by steps of the powers' length; a longer word by Python's own arithmetic
        stop = max(at + 1, int(np.searchsorted(last, first[at] + STEP, side="right")))
        a, b = int(first[at]), int(last[stop - 1])
        if b - a <= STEP:
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
            f, e = first[at:stop] - a, last[at:stop] - a
            out.append(mixed((sums[e] - sums[f]) * down[f] + (e - f).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        else:
            value = 0
            for c in raw[b - 1 : a - 1 if a else None : -1].tolist():
                value = (value * BASE + c + 1) & (2**64 - 1)
            out.append(mixed(np.array([(value + (b - a) * 0xD6E8FEB86659FD93) & (2**64 - 1)], dtype=np.uint64)))
        at = stop
    return np.concatenate(out)


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``n`` words; of all words as one where there are fewer; of none, empty."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(BASE) + words[k : len(words) - width + 1 + k])
    return np.unique(out)


def needed(n: int, num: int, den: int) -> int:
    """How many of ``n`` elements a set shares at least with any set that it is linked to."""
    return -(-n * num // den)


def rarest_count(n: int, num: int, den: int, k: int) -> int:
    """Of a sketch, how many of its rarest values suffice to meet every linked sketch.

    A set within the sketch's size is known whole, and shares a certain part. Of
    a larger one, the union's k smallest values are a sample of the union, and
    the sketches share as many of them as are in both sets: a sum whose mean is
    the similarity, taken six standard deviations low. A set within the size may
    be linked to a larger one, whose sketch leaves values out that they share: of
    the k that it holds, those that the smaller set lacks at most aren't shared.
    """
    p = num / den
    sampled = int(k * p - 6 * (k * p * (1 - p)) ** 0.5)
    if n > k:
        return k - sampled + 1
    shared = needed(n, num, den)
    largest = n * den // num  # of the sets that may be linked; what it has beside the shared part is the most
    if largest > k:
        shared = min(shared, max(sampled, k - (largest - -(-num * (largest + n) // (num + den)))))
    return n - shared + 1


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def may_link(a: np.ndarray, b: np.ndarray, num: int, den: int, k: int) -> bool:
    """Whether two sketches leave a link open: the estimate on their union is within six standard deviations of the threshold or above."""
    union = np.union1d(a, b)[:k]
    if len(union) < k:  # both sets are known whole
        return linked(a, b, num, den)
    both = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    p = num / den
    return both.sum() >= k * p - 6 * (k * p * (1 - p)) ** 0.5


def as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u8")


def digest_of(full: np.ndarray) -> bytes:
    """128 bits that tell a set."""
    return blake2b(full.tobytes(), digest_size=16).digest()


def sketch_batches(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, sketches = [], [], []
        for text in batch.column("text"):  # one full set at a time
            full = shingle_set(text.as_py(), n).astype("<u8")
            sizes.append(len(full))
            digests.append(digest_of(full))
            sketches.append(full[:k].tobytes())
        columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), *columns], ["row_key", "n", "digest", "sketch"])


def typed(docs: DataFrame, *columns: str) -> T.StructType:
    """The row key's own type, and columns told by "name type"."""
    rest = [T.StructField(c.split()[0], T.LongType() if c.endswith("long") else T.BinaryType()) for c in columns]
    return T.StructType([T.StructField("row_key", docs.schema["row_key"].dataType), *rest])


def classes_of(docs: DataFrame, shingle_words: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (row_key, n, digest), classes (digest, cls, first, n) and their sketches (cls, n, sketch): one class for each different set that isn't empty.

    ``first`` is the class's smallest row key, and ``cls`` a number that is the
    class's own, whatever its rows' keys are. Copies are combined before the
    exchange, and the sets themselves, larger than the texts, aren't kept.
    """
    rows = docs.select("row_key", text_or_empty().alias("text"))
    sketches = written(rows.mapInArrow(partial(sketch_batches, n=shingle_words, k=k), typed(docs, "n long", "digest binary", "sketch binary")))
    classes = sketches.where("n > 0").groupBy("digest").agg(F.min("row_key").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # the numbers are those of the written rows, and don't change when the table is read again
    whole = written(classes.withColumn("cls", F.monotonically_increasing_id()))
    members = written(sketches.select("row_key", "n", "digest"))
    dropped(sketches)
    return members, written(whole.select("digest", "cls", "first", "n")), whole.select("cls", "n", "sketch")


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, shingle_words: int) -> DataFrame:
    """(cls, shingles): the full sets of the classes in ``ids`` (cls), made again from the texts of their first rows.

    Where the ids are few enough to send to every task, no text is exchanged.
    Rows that share a key with another text are told apart by their sets' digests.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle_words).astype("<u8") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "shingles"])

    chosen = cut(classes.join(ids.distinct(), "cls", "left_semi").select("digest", "cls", "first"))
    firsts = sent_whole(chosen.select(F.col("first").alias("_first")).distinct(), BROADCAST_IDS)
    rows = docs.select("row_key", text_or_empty().alias("text")).join(firsts, F.col("row_key").eqNullSafe(F.col("_first")), "left_semi").select("text")
    made = rows.mapInArrow(task, "digest binary, shingles binary").dropDuplicates(["digest"])
    return written(made.join(chosen.select("digest", "cls"), "digest").select("cls", "shingles"))


def marks(sketches: list[np.ndarray]) -> np.ndarray:
    """A row of 256 bits for each sketch, as four longs: those that its values name."""
    bits = np.zeros((len(sketches), 256), dtype=bool)
    if len(sketches):
        bits[np.repeat(np.arange(len(sketches)), [len(s) for s in sketches]), (np.concatenate(sketches) & np.uint64(255)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view("<i8")


def may_meet(num: int, den: int, k: int) -> Column:
    """Of rows (na, x0…, nb, y0…): whether sizes and marks allow ``may_link``.

    Each value of one sketch alone sets at most one bit that differs, and sketches
    that may be linked share as many values as the estimate asks for, or where both
    sets are known whole, the threshold's part of them.
    """
    least = int(np.ceil(k * num / den - 6 * (k * num * (den - num)) ** 0.5 / den))
    held = F.least("na", F.lit(k)) + F.least("nb", F.lit(k))
    differing = [F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(len(MARKS))]
    sizes = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    return sizes & (sum(differing[1:], differing[0]) <= F.greatest(held - 2 * least, F.floor(held * (den - num) / (den + num))))


def index_of(classes: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """(value, cls, n, hub, marks…): each class under the rarest values of its sketch. ``hub``: how common its sketch is on the whole."""

    def retained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sketches = [as_set(s).astype(np.int64) for s in frame["sketch"]]
            yield pd.DataFrame({"cls": np.repeat(frame["cls"].to_numpy(), [len(s) for s in sketches]), "value": np.concatenate(sketches) if sketches else np.zeros(0, np.int64)})

    def marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.concat([frame[["cls", "n"]].reset_index(drop=True), pd.DataFrame(marks([as_set(s) for s in frame["sketch"]]), columns=[*MARKS])], axis=1)

    values = classes.select("cls", "sketch").mapInPandas(retained, "cls long, value long")
    frequencies = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    # a value of one class meets no other; the places that such values use up, as the rarest of all, are told by their number
    counted = values.join(frequencies, "value").select("cls", "value", "df").repartition("cls")
    of = W.partitionBy("cls")
    ranked = counted.select("cls", "value", F.row_number().over(of.orderBy("df", "value")).alias("rank"), F.sum("df").over(of).alias("hub"), F.count("*").over(of).alias("met"))
    whole = F.least("n", F.lit(k)).cast("int")
    counts = [rarest_count(n, num, den, k) for n in range(1, k + 2)]
    places = F.when(F.col("n") <= k, F.element_at(F.array(*[F.lit(c) for c in counts[:k]]), whole)).otherwise(counts[k])
    told = classes.select("cls", "n", "sketch").mapInPandas(marked, "cls long, n long, " + ", ".join(f"{m} long" for m in MARKS))
    placed = ranked.where(F.col("rank") <= max(counts)).join(told, "cls")
    return placed.where(F.col("rank") <= places - (whole - F.col("met"))).select("value", "cls", "n", "hub", *MARKS)


def side(rows: DataFrame, cls: str, mark: str, *more: str | Column) -> DataFrame:
    """``rows`` (value, cls, n, marks…) under the names that ``may_meet`` reads."""
    return rows.select(F.col("value").alias(f"v{cls}"), F.col("cls").alias(cls), F.col("n").alias(f"n{cls}"), *[F.col(m).alias(f"{mark}{i}") for i, m in enumerate(MARKS)], *more)


def pairs_of(index: DataFrame, num: int, den: int, k: int, short_list: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to verify, and memberships (cls, pivot) of long lists."""

    def met(rows: DataFrame) -> DataFrame:
        return side(rows, "a", "x").join(side(rows, "b", "y"), (F.col("va") == F.col("vb")) & (F.col("a") < F.col("b")) & may_meet(num, den, k)).select("a", "b")

    counts = index.groupBy("value").agg(F.count("*").alias("here")).where(F.col("here") > short_list)
    long = sent_whole(cut(counts), BROADCAST_IDS)
    direct = met(index.join(long, "value", "left_anti"))
    # of a long list, the classes that another one of it may be linked to; the longest lists keep all
    rows = cut(index.join(long, "value"))
    compared = rows.where(F.col("here") <= MOST_COMPARED)
    partner = (F.col("va") == F.col("vb")) & (F.col("a") != F.col("b")) & may_meet(num, den, k)
    alike = side(compared, "a", "x", "hub").join(side(compared, "b", "y"), partner, "left_semi").toDF("value", "cls", "n", *MARKS, "hub")
    alive = cut(alike.unionByName(rows.where(F.col("here") > MOST_COMPARED).drop("here")))
    top = F.max(F.struct("hub", (-F.col("cls")).alias("cls"), "n", *MARKS)).alias("top")
    lists = alive.groupBy("value").agg(F.count("*").alias("here"), top)
    filed = cut(alive.join(lists, "value"))
    of_pivot = [(-F.col("top.cls")).alias("a"), F.col("top.n").alias("na"), *[F.col(f"top.{m}").alias(f"x{i}") for i, m in enumerate(MARKS)]]
    crowded = side(filed.where(F.col("here") > short_list), "b", "y", *of_pivot)
    members = cut(crowded.select(F.col("b").alias("cls"), F.col("a").alias("pivot")).distinct())
    stars = crowded.where((F.col("a") != F.col("b")) & may_meet(num, den, k)).select("a", "b")  # only pivots are in many pairs
    return direct.unionAll(met(filed.where(F.col("here") <= short_list))).unionAll(stars).distinct(), members


def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y): ``pairs`` with the column of both classes; ``a`` in many pairs, as a pivot is, is spread over tasks."""
    of = table.select("cls", column)
    with_a = joined_evenly(pairs, of.toDF("a", "x"), "a", "b", counted=pairs)
    return with_a.join(of.toDF("b", "y"), "b").select("a", "b", "x", "y")


def passing(rows: DataFrame, test) -> DataFrame:
    """The pairs of ``rows`` (a, b, x, y) for which ``test(x, y)`` holds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(as_set(x.as_py()), as_set(y.as_py())) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(task, "a long, b long")


class Forest:
    """Sets that are joined."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def block_links(frame: pd.DataFrame, num: int, den: int, k: int) -> list[tuple[int, int]]:
    """Links between the open classes and the others of one pair of blocks, less those that others imply."""
    open_ = frame[frame["open"]].drop_duplicates("cls")
    other = frame[~frame["open"]].drop_duplicates("cls").sort_values("n")
    if open_.empty or other.empty:
        return []
    sets = [as_set(s) for s in other["shingles"]]
    sizes, ids, groups = other["n"].to_numpy(), other["cls"].to_numpy(), other["component"].to_numpy()
    # inverted lists of the retained values of the block: one count of shared values for each pair
    values = np.concatenate([s[:k] for s in sets])
    owner = np.repeat(np.arange(len(sets)), [min(k, len(s)) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    forest, found = Forest(), []
    p = num / den
    least = k * p - 6 * (k * p * (1 - p)) ** 0.5
    for cls, component, raw in zip(open_["cls"], open_["component"], open_["shingles"], strict=True):
        mine = as_set(raw)
        sketch = mine[:k]
        lo, hi = np.searchsorted(values, sketch, "left"), np.searchsorted(values, sketch, "right")
        hit = [owner[x:y] for x, y in zip(lo, hi, strict=True) if y > x]
        if not hit:
            continue
        shared = np.bincount(np.concatenate(hit), minlength=len(sets))
        fits = (np.minimum(sizes, len(mine)) * den >= num * np.maximum(sizes, len(mine))) & (groups != component) & (ids != cls)
        # sets that the sketches hold whole need a certain part in common; others a part of the union's sample
        small = np.maximum(sizes, len(mine)) <= k
        enough = np.where(small, shared * den >= num * (len(mine) + sizes - shared), shared >= least)
        for j in np.flatnonzero(fits & enough):
            if forest.root(component) != forest.root(int(groups[j])) and linked(mine, sets[j], num, den):
                forest.join(component, int(groups[j]))
                found.append((int(cls), int(ids[j])))
    return found


def remaining(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int, k: int, block: int) -> DataFrame:
    """Links (a, b) that neither short lists nor pivots show: of classes outside their pivot's component.

    A pivot's classes are dealt into blocks by size, and only blocks whose sizes
    the threshold allows together meet. A task holds two blocks.
    """
    placed = members.join(labels, "cls", "left").select("cls", "pivot", F.coalesce("component", "cls").alias("component"))
    at_pivot = labels.select(F.col("cls").alias("pivot"), F.col("component").alias("pivot_component"))
    placed = placed.join(at_pivot, "pivot", "left").withColumn("open", F.col("component") != F.coalesce("pivot_component", "pivot"))
    busy = placed.where("open").select("pivot").distinct()
    placed = placed.join(busy, "pivot", "left_semi").join(classes.select("cls", "n"), "cls")
    # the position by size within a pivot: counts by size class first, so that no task sorts all classes of a pivot
    size_class = F.floor(F.log(F.col("n").cast("double")) / np.log(den / num)).cast("int")
    placed = cut(placed.select("cls", "pivot", "component", "open", "n", size_class.alias("size")))
    counts = placed.groupBy("pivot", "size").agg(F.count("*").alias("here"), F.max("open").alias("has_open"), F.sum(F.col("open").cast("int")).alias("n_open"))
    parts = counts.select("pivot", "size", F.ceil(F.col("here") / block).cast("int").alias("blocks"), F.ceil(F.col("n_open") / block).cast("int").alias("open_blocks"))
    # sizes that may be linked are in the same or in neighbouring size classes
    opened = placed.where("open").join(parts.select("pivot", "size", "open_blocks"), ["pivot", "size"])
    opened = opened.withColumn("u", F.pmod(F.xxhash64("cls"), "open_blocks")).withColumn("other", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    against = parts.select("pivot", F.col("size").alias("other"), "blocks")
    opened = opened.join(against, ["pivot", "other"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = opened.select("pivot", "size", "u", "other", "x", "cls", "component", "n", F.lit(True).alias("open"))
    rest = placed.join(parts.select("pivot", "size", "blocks"), ["pivot", "size"]).withColumn("x", F.pmod(F.xxhash64("cls"), "blocks"))
    towards = parts.where("open_blocks > 0").select("pivot", F.col("size").alias("to"), "open_blocks")
    rest = rest.withColumn("to", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).join(towards, ["pivot", "to"]).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("open_blocks") - 1)))
    right = rest.select("pivot", F.col("to").alias("size"), "u", F.col("size").alias("other"), "x", "cls", "component", "n", F.lit(False).alias("open"))
    dealt = left.select(*[F.col(c) if c not in ("u", "x") else F.col(c).cast("long").alias(c) for c in left.columns]).unionAll(right.select(*[F.col(c) if c not in ("u", "x") else F.col(c).cast("long").alias(c) for c in left.columns]))
    filled = dealt.join(sets, "cls")

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(frame, num, den, k), columns=["a", "b"]).astype("int64")

    return filled.groupBy("pivot", "size", "u", "other", "x").applyInPandas(task, "a long, b long")


def spanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one task's links (a, b), those that join each class with the smallest that it reaches within the task."""
    forest = Forest()
    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            forest.join(a, b)
    stars = [(x, forest.root(x)) for x in list(forest.up)]
    yield pd.DataFrame(stars, columns=["a", "b"]).astype("int64")


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(cls, component): the smallest class that each class of ``links`` (a, b) reaches.

    First each task puts about ``task_links`` links in the place of which it gives
    stars, and where all are in one task, that is all. Then each round points every
    class at the smallest neighbour of its neighbours (large stars, then small
    stars), until nothing changes, in about as many rounds as the logarithm of the
    longest chain; the table of links never grows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    tasks = -(-edges.count() // task_links)
    edges = cut(edges.coalesce(max(1, tasks)).mapInPandas(spanned, "a long, b long"))
    before = None
    while tasks > 1:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x != m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("component")).unionAll(edges.select(F.col("b").alias("cls"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = 5, num: int = 4, den: int = 5, k: int = K, short_list: int = SHORT_LIST, block: int = BLOCK) -> DataFrame:
    """(row_key, n_shingles, component, kept) for each row of ``docs`` (row_key, text).

    ``component`` is the smallest row key that the row reaches over links of a
    similarity of num/den and more, itself included; ``kept``: it is the row's own.
    Row keys are of any type that has an order; rows may share one, and are then
    told apart by their texts. A null key comes after all others, and what reaches
    no other key has a null ``component`` and is kept. Whole texts are read. Null,
    empty and blank texts have an empty set and are linked with nothing; a text of
    fewer words than a shingle has one shingle, all of it. An empty table gives no
    rows. Other columns are not read.
    """
    with small_batches(docs.sparkSession), shuffles_let_go(docs.sparkSession):
        return linked_rows(docs, shingle_words, num, den, k, short_list, block)


def linked_rows(docs: DataFrame, shingle_words: int, num: int, den: int, k: int, short_list: int, block: int) -> DataFrame:
    members, classes, sketches = classes_of(docs, shingle_words, k)
    index = written(index_of(sketches, num, den, k))  # read several times
    pairs, lists = pairs_of(index, num, den, k, short_list)
    pairs = cut(pairs)
    dropped(index)
    pairs = cut(passing(with_both(pairs, sketches, "sketch"), lambda x, y: may_link(x, y, num, den, k)))
    dropped(sketches)
    ids = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).unionAll(lists.select("cls"))
    sets = sets_of(docs, classes, ids, shingle_words)
    links = cut(passing(with_both(pairs, sets, "shingles"), lambda x, y: linked(x, y, num, den)))
    labels = cut(components(links))
    rest = cut(remaining(lists, labels, classes, sets, num, den, k, block))
    dropped(sets)
    if not rest.isEmpty():
        labels = cut(components(labels.select(F.col("cls").alias("a"), F.col("component").alias("b")).unionAll(rest)))
    # a component's name is the smallest row key of its classes
    named = cut(labels.join(classes.select("digest", "cls", "first"), "cls").select("digest", "first", "component"))
    names = named.groupBy("component").agg(F.min("first").alias("name"))
    far = joined_evenly(named.select("digest", "component"), names, "component", "digest", counted=named).select("digest", "name")
    alone = classes.join(labels, "cls", "left_anti").select("digest", F.col("first").alias("name"))
    classed = far.unionAll(alone)
    out = members.join(classed, "digest", "left").select("row_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("row_key")).alias("component"))
    return out.withColumn("kept", F.col("row_key").eqNullSafe(F.col("component")))
