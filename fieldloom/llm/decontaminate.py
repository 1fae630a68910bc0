"""Benchmark decontamination by greedy string tiling.

Windows of five words that a document shares with a benchmark item are seeds, met
by an equi-join of the benchmark's table of seeds with the documents' windows; a
bit filter of bounded size keeps the windows of no item from the exchange. Of each
pair that shares a seed, running Karp-Rabin hashes find matches of at least a
seed's length; the longest are marked again and again, so that no word of the
item or the document is in two tiles. Of equal lengths the first in the item, then
the first in the document, is marked. The share of the item's words under tiles,
in whatever order they stand in the document, is its coverage; from a threshold
on, the document holds the item.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, joined_evenly, row_digest, sent_whole, small_batches, text_or_empty, written
from .near_duplicates import word_hashes

WORD = re.compile(r"\w+")
SEED_WORDS = 5
THRESHOLD = 0.5
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
FILTER_BITS = 27  # 16 MB at most; a larger benchmark lets more windows through to the join
BITS_A_SEED = 16
BROADCAST_TEXTS = 1_000_000


def words_of(text: str) -> np.ndarray:
    """The hashes of a text's words in lower case, in order.

    They are worked out from the text alone: a worker keeps no word, so its memory
    doesn't grow with the words that it has met.
    """
    return word_hashes(" ".join(WORD.findall(text.lower())))


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``n`` ids, modulo 2^64."""
    m = max(0, len(ids) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out *= BASE
        out += ids[k : k + m].astype(np.uint64) + np.uint64(1)
    return out


def seeds_of(words: np.ndarray, n: int) -> np.ndarray:
    """The windows' hashes with all bits mixed."""
    x = window_hashes(words, n)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def stretches(at: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(first, end) of the words under the windows of ``n`` words that begin ``at`` ascending places."""
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > n) + 1
    return [(int(part[0]), int(part[-1]) + n) for part in np.split(at, breaks)]


def tiles(item: np.ndarray, runs: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """(start in the item, length) of the tiles between ``item`` and ``runs``, no word used twice.

    ``runs`` are stretches of a document, and a tile lies within one of them. The
    search length begins at the longest run and halves when no match of that length
    is left; what is free of a match that others cover in part is a match again.
    """
    free_item = np.ones(len(item), dtype=bool)
    free = [np.ones(len(r), dtype=bool) for r in runs]
    found: list[tuple[int, int]] = []
    s = max(least, min(len(item), max((len(r) for r in runs), default=0)))
    while True:
        matches = all_matches(item, runs, free_item, free, s)
        heapify(matches)
        while matches:
            n, i, r, j = heappop(matches)
            both = free_item[i : i - n] & free[r][j : j - n]
            if both.all():
                free_item[i : i - n] = free[r][j : j - n] = False
                found.append((i, -n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], both, [False]]).astype(np.int8)))
            for first, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if end - first >= s:
                    heappush(matches, (first - end, i + first, r, j + first))
        if s == least:
            return found
        s = max(least, s // 2)


def all_matches(item: np.ndarray, runs: list[np.ndarray], free_item: np.ndarray, free: list[np.ndarray], s: int) -> list[tuple[int, int, int, int]]:
    """(-length, place in the item, run, place in the run) of the longest free matches of ``s`` words and more."""
    places, out = defaultdict(list), []
    for i, h in enumerate(window_hashes(item, s).tolist()):
        if free_item[i : i + s].all():
            places[h].append(i)
    if not places:
        return out
    for r, run in enumerate(runs):
        for j, h in enumerate(window_hashes(run, s).tolist()):
            if h not in places or not free[r][j : j + s].all():
                continue
            for i in places[h]:
                if i and j and item[i - 1] == run[j - 1] and free_item[i - 1] and free[r][j - 1]:
                    continue  # a part of the match one word before
                n = 0
                while i + n < len(item) and j + n < len(run) and item[i + n] == run[j + n] and free_item[i + n] and free[r][j + n]:
                    n += 1
                if n >= s:
                    out.append((-n, i, r, j))
    return out


def coverage(item: np.ndarray, parts: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """The tiles between an item and the stretches of a document that hold seeds of any item.

    Of stretches that say the same, as many are looked at as the item has room
    for tiles: the later ones could not be reached.
    """
    own, room = window_hashes(item, least), len(item) // least
    runs, seen = [], Counter()
    for part in parts:
        for first, end in stretches(np.flatnonzero(np.isin(window_hashes(part, least), own)), least):
            run = part[first:end]
            told = run.tobytes()
            seen[told] += 1
            if seen[told] <= room:
                runs.append(run)
    return tiles(item, runs, least)


# --------------------------------------------------------------- as Spark jobs
def item_tables(benchmark: DataFrame, seed_words: int) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, words) and their seeds (seed, item); ``item`` numbers the benchmark's rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([words_of(t.as_py()).astype("<u8").tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), words], ["item_id", "words"])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(seeds_of(as_words(w), seed_words)).view(np.int64) for w in batch.column("words")]
            numbers = np.repeat(np.array(batch.column("item").to_pylist(), dtype=np.int64), [len(s) for s in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)), pa.array(numbers, pa.int64())], ["seed", "item"])

    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    items = written(rows.mapInArrow(read, "item_id long, words binary").withColumn("item", F.monotonically_increasing_id()))
    return items, written(items.select("item", "words").mapInArrow(seeds, "seed long, item long"))


def as_words(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_py(), dtype="<u8")


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each seed under its highest bits, in words of 64, and how many of the bits count: a bounded size whatever the seeds are."""
    n = seeds.count()
    bits = min(FILTER_BITS, max(16, (BITS_A_SEED * n).bit_length()))
    place = F.shiftrightunsigned("seed", 64 - bits)
    said = seeds.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 as int))").alias("bit")).groupBy("at").agg(F.expr("bit_or(bit)").alias("bit")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[said["at"].to_numpy()] = said["bit"].to_numpy().view(np.uint64)
    return words, bits


def candidates(rows: DataFrame, seeds: DataFrame, seed_words: int) -> DataFrame:
    """(doc, key, seeds, lengths, words) of the ``rows`` (key, text) with a window that may be a seed, whose texts are read whole.

    ``words`` are those of the stretches under such windows.
    """
    spark = rows.sparkSession
    found, bits = seed_filter(seeds)
    sent = spark.sparkContext.broadcast(found)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            keep, own, lengths, said = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                hashes = seeds_of(words, seed_words)
                place = hashes >> np.uint64(64 - bits)
                at = np.flatnonzero(table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                if len(at):
                    parts = stretches(at, seed_words)
                    keep.append(k)
                    own.append(np.unique(hashes[at]).view(np.int64))
                    lengths.append([end - first for first, end in parts])
                    said.append(np.concatenate([words[first:end] for first, end in parts]).astype("<u8").tobytes())
            columns = [batch.column("key").take(pa.array(keep, pa.int64())), pa.array(own, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32())), pa.array(said, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "seeds", "lengths", "words"])

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL("seeds array<long>, lengths array<int>, words binary").fields])
    return written(rows.mapInArrow(read, schema).withColumn("doc", F.monotonically_increasing_id()))


def held(rows: DataFrame, benchmark: DataFrame, threshold: float, seed_words: int) -> DataFrame:
    """(key, item_id, item_words, covered_words, coverage, n_tiles, longest_tile) for each of ``rows`` (key, text) and each item that it holds."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k, (item, words, lengths) in enumerate(zip(batch.column("item_words"), batch.column("words"), batch.column("lengths"), strict=True)):
                own = as_words(item)
                got = coverage(own, np.split(as_words(words), np.cumsum(lengths.as_py())[:-1]), seed_words)
                covered = sum(n for _, n in got)
                if got and covered >= threshold * len(own):
                    keep.append(k)
                    out.append((len(own), covered, covered / len(own), len(got), max(n for _, n in got)))
            at = pa.array(keep, pa.int64())
            numbers = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("item_id").take(at), *numbers], ["key", "item_id", "item_words", "covered_words", "coverage", "n_tiles", "longest_tile"])

    with small_batches(rows.sparkSession):
        items, seeds = item_tables(benchmark, seed_words)
        docs = candidates(rows, seeds, seed_words)
        asked = docs.select("doc", F.explode("seeds").alias("seed"))
        pairs = cut(joined_evenly(asked, seeds, "seed", "doc", counted=asked).select("doc", "item").distinct())
        told = joined_evenly(pairs, items.select("item", "item_id", F.col("words").alias("item_words")), "item", "doc", counted=pairs)
        schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL("item_id long, item_words int, covered_words int, coverage double, n_tiles int, longest_tile int").fields])
        return cut(told.join(docs.select("doc", "key", "lengths", "words"), "doc").mapInArrow(tile, schema))


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile) for each document that holds an item.

    Every document is compared over its whole text with every item. Null and empty
    texts hold nothing, and items of fewer words than a seed are held by none.
    Items without an id are left out; items that share one have a row each. A row
    is returned for each row of ``docs``, repeated ids included, null ones too.
    Other columns are not read. An empty table on either side gives no rows.
    """
    rows = docs.select(F.col("doc_id").alias("key"), text_or_empty().alias("text"))
    return held(rows, benchmark, threshold, seed_words).withColumnRenamed("key", "doc_id")


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed_words: int = SEED_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item of ``benchmark``, with all of their columns (names that begin with ``_fl_`` are reserved).

    Texts that hold one are few; told by 128-bit digests, they are sent to every
    task under a bound, and no text is exchanged then.
    """
    rows = docs.select(row_digest("text").alias("key"), text_or_empty().alias("text"))
    bad = cut(held(rows, benchmark, threshold, seed_words).select(F.col("key").alias("_fl_held")).distinct())
    return docs.join(sent_whole(bad, BROADCAST_TEXTS), row_digest("text") == F.col("_fl_held"), "left_anti")
