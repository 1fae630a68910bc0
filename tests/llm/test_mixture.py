import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import mixture as M


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"w{i} " * (5 + i % 7), "hot" if i % 3 else f"s{i % 9}") for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


def totals(docs):
    out = Counter()
    for r in docs.collect():
        out[r["source"]] += len(r["text"].split())
    return out


@pytest.mark.parametrize("target", [0.9, 0.97])
def test_exponent_meets_the_entropy(docs, target):
    t = totals(docs)
    sources = docs.sparkSession.createDataFrame(list(t.items()), "source string, source_tokens long")
    got = M.solve(sources, target, 1e9, None)
    total, n = sum(t.values()), len(t)
    power = {s: (c / total) ** got.exponent for s, c in t.items()}
    z = sum(power.values())
    entropy = -sum(p / z * math.log(p / z) for p in power.values())
    assert abs(entropy - target * math.log(n)) < 1e-3 or got.exponent == 1.0 and entropy >= target * math.log(n)
    assert entropy >= target * math.log(n) - 1e-9


def test_repetition_is_limited(docs):
    t = totals(docs)
    sources = docs.sparkSession.createDataFrame(list(t.items()), "source string, source_tokens long")
    got = M.solve(sources, 1.0, 1.5, None)
    ratio = (max(t.values()) / min(t.values())) ** (1 - got.exponent)
    assert ratio <= 1.5 + 1e-6 and ratio > 1.49


def test_readings(docs):
    got = M.mix(docs, target=0.97, max_repeats=3.0, block_tokens=500).collect()
    read = defaultdict(Counter)
    for r in got:
        read[r["source"]][r["doc_id"]] += 1
    assert {d for c in read.values() for d in c} == set(range(900))  # each document once at least
    for counts in read.values():
        assert max(counts.values()) - min(counts.values()) <= 1  # passes are permutations
        assert max(counts.values()) <= 4
    places = [(r["block"], r["slot"]) for r in got]
    assert len(places) == len(set(places))
    tokens = Counter()
    for r in got:
        tokens[r["block"]] += r["tokens"]
    assert max(tokens.values()) < 1.5 * 500 + 50
    blocks = {b: {r["source"] for r in got if r["block"] == b} for b in list(tokens)[:20]}
    assert all("hot" in s and len(s) > 1 for s in blocks.values())
    again = {(r["block"], r["slot"], r["doc_id"]) for r in M.mix(docs, target=0.97, max_repeats=3.0, block_tokens=500).collect()}
    assert again == {(r["block"], r["slot"], r["doc_id"]) for r in got}


def test_readings_by_hand(docs):
    """The same plan without buckets or partitions: sources in passes laid end to end, blocks of even width, one order in each."""
    got = {(r["block"], r["slot"]): (r["doc_id"], r["pass"]) for r in M.mix(docs, target=0.97, max_repeats=3.0, block_tokens=500).collect()}
    t = totals(docs)
    sources = docs.sparkSession.createDataFrame(list(t.items()), "source string, source_tokens long")
    m = M.solve(sources, 0.97, 3.0, None)
    key = M.row_digest(*M.UNIT).alias("row_key")
    rows = docs.select(key, "doc_id", "source", F.size(F.split(F.trim("text"), " ")).alias("tokens"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pass"))
    rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(17), "source", "pass", "row_key"), 11)).withColumn("order", F.xxhash64(F.lit(18), "pass", "row_key")).collect()
    blocks = defaultdict(list)
    n_blocks = max(1, math.ceil(m.budget / 500))
    for source, tokens in t.items():
        granted = round(m.budget * (tokens / m.total) ** m.exponent / m.normaliser, 3)
        for k in range(max(1, math.ceil(round(granted / tokens, 6)))):
            at = k * tokens
            for r in sorted((r for r in rows if r["source"] == source and r["pass"] == k), key=lambda r: (r["place"], r["row_key"])):
                if k == 0 or at < granted:
                    blocks[min(n_blocks - 1, int(at / max(granted, tokens) * n_blocks))].append((r["order"], r["row_key"], k, r["doc_id"]))
                at += r["tokens"]
    assert got == {(b, i): (x[3], x[2]) for b, held in blocks.items() for i, x in enumerate(sorted(held))}


def test_given_budget(docs):
    total = sum(totals(docs).values())
    got = M.mix(docs, budget_tokens=total / 2).agg(F.sum("tokens")).first()[0]
    assert 0.45 * total < got < 0.6 * total


def test_odd_tables(odd_docs, no_docs):
    assert M.mix(no_docs).count() == 0
    got = M.mixed_documents(odd_docs, max_repeats=1.0)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    empty = odd_docs.where("doc_id in (2, 3, 4)")
    assert M.mixed_documents(empty).count() == 3
