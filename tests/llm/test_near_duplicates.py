import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import near_duplicates as N


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_set(text, n):
    w = plain_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_classes(rows, n, num, den):
    sets = {k: plain_set(t, n) for k, t in rows}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def corpus(seed):
    """Groups of near copies around the threshold, exact copies, short texts of common words, blanks."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for g in range(5):
        base = [f"g{g}w{i}" for i in range(rng.choice((12, 80, 200)))]
        for _ in range(rng.choice((3, 40))):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 7)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            rows.append(" ".join(copy))
    rows += [" ".join(rng.choice(common) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    rows += [rows[0], rows[1].upper(), "", "  \t\n ", None, "one"]
    keys = rng.sample(range(-1000, 1000), len(rows))
    return list(zip(keys, rows, strict=True))


@pytest.mark.parametrize(("seed", "n", "lists"), [(1, 2, 24), (2, 2, 3), (3, 5, 24), (4, 1, 2)])
def test_same_as_all_pairs(spark, seed, n, lists):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "row_key long, text string")
    got = {r["row_key"]: (r["n_shingles"], r["component"]) for r in N.near_duplicates(docs, n, 80, 100, k=32, short_list=lists, block=16).collect()}
    assert got == plain_classes(rows, n, 80, 100)


def test_sets_within_the_sketch_meet_larger_ones(spark):
    """Sizes on both sides of the sketch's, by brute force; no other document holds a value of the pair."""
    texts = []
    for small in range(60, 65):
        for large in range(75, small * 5 // 4 + 2):
            for again in range(3):
                words = [f"s{small}l{large}a{again}w{i}" for i in range(large)]
                texts += [" ".join(words[:small]), " ".join(words)]
    texts += [" ".join(f"p{i}" for i in range(x, x + n)) for x, n in ((0, 65), (6, 65))]
    rows = list(enumerate(texts))
    got = {r["row_key"]: (r["n_shingles"], r["component"]) for r in N.near_duplicates(spark.createDataFrame(rows, "row_key long, text string"), 1).collect()}
    assert got == plain_classes(rows, 1, 4, 5)


def test_places_suffice_for_the_worst_partner():
    for k in (8, 32, 64):
        for num, den in ((4, 5), (9, 10), (19, 20)):
            p = num / den
            sampled = int(k * p - 6 * (k * p * (1 - p)) ** 0.5)
            for n in range(1, k + 1):
                for m in range(n, n * den // num + 1):
                    shared = -(-num * (m + n) // (num + den))
                    met = shared if m <= k else max(k - (m - shared), sampled)  # of the values that both sketches hold
                    assert N.rarest_count(n, num, den, k) > n - met and N.rarest_count(m, num, den, k) > min(m, k) - met


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "é", " ", "\n", "\x0b", " ", "longer"]), max_size=40), st.integers(1, 4))
def test_sets_have_the_sizes_of_plain_sets(parts, n):
    text = "".join(parts)
    assert len(N.shingle_set(text, n)) == len(plain_set(text, n))
    assert len(N.word_hashes(text)) == len(plain_words(text))


def test_words_of_any_length_hash_alike():
    word = "q" * (N.STEP + 5)
    text = " ".join(["a" * 10, word, *["ab cd"] * 30_000, word, "ab"])
    h = N.word_hashes(text)
    assert len(h) == 60_004 and h[1] == h[-2] and h[2] == h[-1] and len(np.unique(h)) == 4
    assert N.word_hashes("ab")[0] == h[-1] and N.word_hashes("x " + "a" * 10)[1] == h[0]


def test_odd_tables(spark, odd_docs, no_docs):
    shape = lambda d: d.withColumn("row_key", F.coalesce("doc_id", F.lit(-1)))
    got = N.near_duplicates(shape(odd_docs))
    assert got.count() == odd_docs.count()
    assert {r["row_key"] for r in got.where("not kept").collect()} == {6}
    assert N.near_duplicates(shape(no_docs)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r["cls"]: r["component"] for r in N.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90}


def test_components_of_links_in_several_tasks(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(200, 200 + rng.randint(1, 99)) for _ in range(60)] + [(rng.randint(400, 900), rng.randint(400, 900)) for _ in range(250)]
    forest = N.Forest()
    for a, b in links:
        forest.join(a, b)
    want = {x: forest.root(x) for a, b in links if a != b for x in (a, b)}
    for size in (20, 10_000):
        got = N.components(spark.createDataFrame(links, "a long, b long").repartition(7), size).collect()
        assert {r["cls"]: r["component"] for r in got} == want and len(got) == len(want)


def test_links_of_one_task_become_stars():
    import pandas as pd

    frames = [pd.DataFrame([(3, 2), (5, 4)], columns=["a", "b"]), pd.DataFrame([(4, 3)], columns=["a", "b"])]
    (stars,) = N.spanned(iter(frames))
    assert sorted(map(tuple, stars.to_numpy().tolist())) == [(3, 2), (4, 2), (5, 2)]


def test_sketches_and_sets_are_deleted_once_read(spark):
    """Only what the result reads is left: rows' digests, and classes without sketches."""
    import os

    from fieldloom.llm import common

    before = set(common.WRITTEN)
    rows = corpus(7)
    found = N.near_duplicates(spark.createDataFrame(rows, "row_key long, text string"), 2, 80, 100, short_list=3, block=16)
    left = [p for p in common.WRITTEN if p not in before]
    assert sorted(sorted(spark.read.parquet(p).columns) for p in left) == [["cls", "digest", "first", "n"], ["digest", "n", "row_key"]]
    assert found.count() == len(rows)
    folder = os.path.dirname(left[0]).removeprefix("file:")
    assert {p.rsplit("/", 1)[-1] for p in left} <= set(os.listdir(folder)) and len(os.listdir(folder)) >= 2


def test_classes_that_share_common_words_only_are_no_pairs(spark, monkeypatch):
    """Every text meets many others in lists, short and long, and few are alike: lists give those, not all who meet."""
    rng = random.Random(11)
    texts = [" ".join(f"w{int(1500 * rng.random() ** 2)}" for _ in range(90)) for _ in range(300)]
    for k in range(20):
        words = texts[k].split()
        words[rng.randrange(len(words))] = f"x{k}"
        texts.append(" ".join(words))
    told, joined = [], N.with_both
    monkeypatch.setattr(N, "with_both", lambda pairs, *r: told.append(pairs.count()) or joined(pairs, *r))
    rows = list(enumerate(texts))
    for most in (1 << 13, 40):  # the longest lists are left to their pivots
        monkeypatch.setattr(N, "MOST_COMPARED", most, raising=False)
        got = {r["row_key"]: (r["n_shingles"], r["component"]) for r in N.near_duplicates(spark.createDataFrame(rows, "row_key long, text string"), 1, short_list=12).collect()}
        assert got == plain_classes(rows, 1, 4, 5)
    assert told[0] < 1000, told  # over 20,000 meet in lists


@pytest.mark.parametrize("k", [8, 32, 64])
def test_marks_let_every_pair_through_that_may_be_linked(spark, k):
    rng = np.random.default_rng(k)
    rows, linkable = [], 0
    for _ in range(1500):
        union = rng.integers(0, 2**64, size=rng.integers(1, 150), dtype=np.uint64)
        a, b = (np.sort(union[rng.random(len(union)) < x]) for x in (1, rng.choice([0.5, 0.8, 0.9, 1])))
        b = np.union1d(b, rng.integers(0, 2**64, size=rng.integers(0, 10), dtype=np.uint64))
        if min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)):
            linkable += (may := bool(N.may_link(a[:k], b[:k], 4, 5, k)))
            rows.append((may, len(a), *N.marks([a[:k]])[0].tolist(), len(b), *N.marks([b[:k]])[0].tolist()))
    names = ["may", "na", *[f"x{i}" for i in range(4)], "nb", *[f"y{i}" for i in range(4)]]
    table = spark.createDataFrame(rows, names)
    assert linkable > 300 and table.where("may").where(~N.may_meet(4, 5, k)).count() == 0


def test_kept_tables_let_go_of_their_shuffle_files(spark):
    import glob
    import time

    from fieldloom.llm import common

    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, was = files(), spark.conf.get(common.CLEANUP_SETTING)
    with common.shuffles_let_go(spark):
        kept = [common.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()), common.written(spark.range(1000).groupBy((F.col("id") % 5).alias("k")).count())]
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(common.CLEANUP_SETTING) == was
    assert [k.count() for k in kept] == [7, 5]
