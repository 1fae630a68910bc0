import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import decontaminate as D


def plain_tiling(item, doc, least):
    """Greedy string tiling by its definition: the longest match of unmarked words again and again."""
    used_i, used_d, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not used_i[i + n] and not used_d[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        for k in range(n):
            used_i[i + k] = used_d[j + k] = True
        total += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.lists(st.integers(0, 2), min_size=1, max_size=14))
def test_tiles_do_not_overlap_and_cover_what_greed_covers(item, doc):
    got = D.tiles(np.array(item), [np.array(doc)], 2)
    places = [k for i, n in got for k in range(i, i + n)]
    assert len(places) == len(set(places))
    assert all(n >= 2 for _, n in got)
    assert sum(n for _, n in got) == plain_tiling(item, doc, 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=3, max_size=16), st.lists(st.integers(0, 4), max_size=60))
def test_stretches_with_seeds_give_the_tiles_of_the_whole_document(item, doc):
    item, doc = np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64)
    hit = np.flatnonzero(np.isin(D.window_hashes(doc, 3), D.window_hashes(np.concatenate([item, [2, 1, 0, 1, 2]]).astype(np.uint64), 3)))
    got = D.coverage(item, [doc[a:b] for a, b in D.stretches(hit, 3)], 3)
    assert sum(n for _, n in got) == plain_tiling(item.tolist(), doc.tolist(), 3)


@pytest.mark.parametrize("times", [4, 63, 64, 65, 500])
def test_a_passage_said_over_and_over_covers_alike(times):
    item = np.array([*range(9), 100, *range(9), 101, *range(9), 102, *range(9)], dtype=np.uint64)
    parts = [np.arange(9, dtype=np.uint64)] * times
    assert sum(n for _, n in D.coverage(item, parts, 5)) == 36


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_passages_in_order_or_not(spark, odd_docs):
    bench = spark.createDataFrame([(1, words(0, 40)), (2, words(100, 130)), (3, "too few"), (4, None), (None, words(0, 9))], "item_id long, text string")
    docs = spark.createDataFrame(
        [(10, "before " + words(0, 40) + " after"), (11, words(25, 40) + " x " + words(0, 12)), (12, words(0, 12) + " y"), (13, words(100, 130).upper().replace(" ", ", ")), (14, "nothing"), (None, words(0, 40)), (15, words(0, 40) + " " + words(100, 130))], "doc_id long, text string"
    )
    got = {(r["doc_id"], r["item_id"]): r["covered_words"] for r in D.contaminations(docs, bench).collect()}
    assert got == {(10, 1): 40, (11, 1): 27, (13, 2): 30, (None, 1): 40, (15, 1): 40, (15, 2): 30}
    assert sorted(r["doc_id"] for r in D.clean_documents(docs, bench).collect()) == [12, 14]


def test_a_crowded_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "FILTER_BITS", 6)  # every window goes to the join
    bench = spark.createDataFrame([(k, words(40 * k, 40 * k + 40)) for k in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(k, words(20 * k, 20 * k + 30)) for k in range(120)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminations(docs, bench).collect()}
    assert got == {(d, i) for d in range(120) for i in range(60) if min(20 * d + 30, 40 * i + 40) - max(20 * d, 40 * i) >= 20}


def test_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, words(0, 40))], "item_id long, text string")
    assert D.contaminations(odd_docs, bench).count() == 0
    assert D.contaminations(no_docs, bench).count() == 0
    assert D.contaminations(odd_docs, bench.where("false")).count() == 0
    clean = D.clean_documents(odd_docs, bench)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()


def plain_held(doc, items, least=5, threshold=0.5):
    """Items that a text holds, each compared with all of the text by the definition of greedy tiling."""
    own, out = re.findall(r"\w+", doc.lower()), {}
    windows = {tuple(own[k : k + least]) for k in range(len(own) - least + 1)}
    for item_id, text in items:
        w = re.findall(r"\w+", text.lower())
        if any(tuple(w[k : k + least]) in windows for k in range(len(w) - least + 1)):
            covered = plain_tiling(w, own, least)
            if covered and covered >= threshold * len(w):
                out[item_id] = covered
    return out


def test_query_is_the_definition(spark):
    from fieldloom.llm.queries import op1_decontamination, table

    sf = "/root/testdata/sf0.001"
    items = [(r["item_id"], r["text"] or "") for r in table(spark, sf, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]): r["covered_words"] for r in op1_decontamination(spark, sf).collect()}
    want = {(r["doc_id"], i): n for r in table(spark, sf, "documents").collect() if len(r["text"] or "") < 20_000 for i, n in plain_held(r["text"] or "", items).items()}
    long_ones = {r["doc_id"] for r in table(spark, sf, "documents").collect() if len(r["text"] or "") >= 20_000}
    assert {k: n for k, n in got.items() if k[0] not in long_ones} == want and want


def test_a_worker_keeps_no_words():
    import tracemalloc

    D.words_of("a first text")
    tracemalloc.start()
    for k in range(50):
        assert len(set(D.words_of(" ".join(f"Wort{k}x{i}" for i in range(2_000))).tolist())) == 2_000
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 500_000


def test_words_are_told_by_their_letters_alone():
    plain = D.words_of("straße don t x_1 日本 end").tolist()
    assert len(set(plain)) == 6
    assert D.words_of("  STRAßE, don't x_1;日本\nEnd.").tolist() == plain
    assert len(D.words_of("")) == len(D.words_of(" .,; ")) == 0
