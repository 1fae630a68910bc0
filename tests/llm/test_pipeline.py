import math
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        before = docs
        docs = C.written(stage(spark, docs, SF))
        out[name] = (before, docs)
    return out


def test_columns_and_order(stages):
    assert list(stages) == ["language", "near_duplicates", "decontamination", "mixture", "tokens"]
    for name, (before, after) in stages.items():
        if name != "tokens":
            assert after.columns == before.columns


def test_language_keeps_documents_with_a_language(stages):
    before, after = stages["language"]
    assert after.count() == before.count()


def test_one_of_each_group_stays(stages):
    from .test_near_duplicates import plain_classes

    before, after = stages["near_duplicates"]
    want = plain_classes([(r["doc_id"], r["text"]) for r in before.collect()], 5, 4, 5)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(k for k, (_, c) in want.items() if c == k)


def test_benchmark_passages_go(stages, spark):
    before, after = stages["decontamination"]
    clean = lambda s: " ".join(s.lower().split())
    items = [clean(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        if any(i in clean(r["text"]) for i in items):
            assert r["doc_id"] not in kept
    assert len(kept) > 0.8 * before.count()


def test_mixture_reads_all(stages):
    before, after = stages["mixture"]
    counts = Counter(r["doc_id"] for r in after.collect())
    assert set(counts) == {r["doc_id"] for r in before.collect()} and max(counts.values()) <= 2


def test_tokens(stages):
    before, after = stages["tokens"]
    assert after.count() == before.count()
    total = after.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert total[0] == total[1]


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in C.STAGES[:4]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            if name != "mixture":
                assert out.count() <= docs.count()
                continue
            given, read = (Counter((r["doc_id"], r["text"]) for r in d.collect()) for d in (docs, out))
            assert set(given) == set(read) and all(given[k] <= read[k] <= math.ceil(C.MAX_REPEATS) * given[k] for k in given)


def test_ids_may_repeat_or_be_missing(spark, no_docs):
    """Rows with one id and other texts, and rows without an id, are rows of their own at every stage."""
    say = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [(1, say(1)), (1, say(2)), (None, say(3)), (None, say(4)), (-5, say(5)), (2, say(1)), (None, say(5)), (None, say(3))]
    docs = spark.createDataFrame([(*t, "en", "a", 1, "x", 0.5, 9) for t in texts], no_docs.schema)
    got = Counter((r["doc_id"], r["text"]) for r in C.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(1, say(1)), (1, say(2)), (None, say(3)), (None, say(4)), (-5, say(5))])
