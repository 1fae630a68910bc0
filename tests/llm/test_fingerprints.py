import hashlib

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import fingerprints as X


SIZES = [(0, 0, 0), (1, 0, 0), (5, 5, 5), (40, 60, 30), (300, 2, 0), (1, 1, 0), (2000, 2000, 1990), (500, 480, 240), *[(3, 3, 1), (9, 9, 6)] * 30]


def compared(spark, sizes):
    rows = [(k, list(range(k * 10_000, k * 10_000 + a)), list(range(k * 10_000 + a - s, k * 10_000 + a - s + b))) for k, (a, b, s) in enumerate(sizes)]
    sets = spark.createDataFrame(rows, "k long, a array<long>, b array<long>").repartition(4)
    sides = sets.select("k", F.lit(0).alias("side"), "a").unionAll(sets.select("k", F.lit(1).alias("side"), F.col("b").alias("a")))
    cells = X.subtracted(X.stored_cells(sides, ["k", "side"]), "k").where("side = 1")
    got = {r["k"]: (r["only_a"], r["only_b"]) for r in X.compare(sets.select("k", "a", F.col("b").alias("b1"), F.lit(None).cast("array<long>").alias("b2")), cells, "k").collect()}
    want = {k: (len(set(a) - set(b)), len(set(b) - set(a))) for k, a, b in rows}
    return got, {k: v for k, v in want.items() if v != (0, 0)}


def test_peeling_recovers_every_difference(spark):
    got, want = compared(spark, SIZES)
    assert {k: v for k, v in got.items() if v != (0, 0)} == want


def test_small_sketches_suffice_for_small_differences(spark, monkeypatch):
    monkeypatch.setattr(X, "width_for", None)  # never asked for a larger one
    got, want = compared(spark, [(200, 200, 196), (3000, 3001, 3000), (4, 4, 2)])
    assert {k: v for k, v in got.items() if v != (0, 0)} == want


def test_too_small_a_sketch_is_made_again_and_sets_decide_in_the_end(spark, monkeypatch):
    attempts = []

    def narrow(about, n_a, n_b, attempt):
        attempts.append(attempt)
        return F.lit(2).cast("long")

    monkeypatch.setattr(X, "width_for", narrow)
    monkeypatch.setattr(X, "ATTEMPTS", 3)
    assert compared(spark, [(50, 40, 10)]) == ({0: (40, 30)}, {0: (40, 30)})
    assert attempts == [1, 2]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["", None, "a", "ab cd", "One sentence. " * 3, *[" ".join(f"s{k}w{i}{'.' if i % 8 == 7 else ''}" for i in range(40 * k)) for k in range(1, 9)], "One sentence. " * 3, "x" * 5000]
    return spark.createDataFrame([(3 * i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, side int")


def plain_likeness(pieces, a, b):
    every = pieces[a] | pieces[b]
    return len(pieces[a] & pieces[b]) / len(every) if every else 1.0


def test_versions(docs):
    got = {r["doc_id"]: r for r in X.version_fingerprints(docs).collect()}
    texts = [(r["doc_id"], r["text"] or "") for r in sorted(docs.collect())]
    assert len(got) == len(texts)
    by_text, pieces = {}, {}
    said = {t for _, t in texts} | {t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][1][: len(t) // 2] for k, (_, t) in enumerate(texts)}
    for r in docs.sparkSession.createDataFrame([(t,) for t in said], "text string").select("text", X.pieces(F.col("text")).alias("p")).collect():
        pieces[r["text"]] = set(r["p"])
    for k, (i, t) in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(k + 1) % len(texts)][1][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
        by_text.setdefault(t, set()).add(got[i]["fingerprint"])
        by_text.setdefault(edited, set()).add(got[i]["edited_fingerprint"])
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(pieces, t, edited))
        assert got[i]["near_next"] == pytest.approx(plain_likeness(pieces, t, texts[(k + 1) % len(texts)][1]))
        if len(t) >= 200 and t[0] == "s":
            assert got[i]["near_edited"] > got[i]["near_next"]
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert got[0]["near_next"] == 1.0 and got[0]["near_edited"] == 1.0  # empty beside empty


def test_odd_tables(odd_docs, no_docs):
    got = X.version_fingerprints(odd_docs)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert X.version_fingerprints(no_docs).count() == 0
    alone = X.version_fingerprints(odd_docs.where("doc_id = 1")).first()
    assert alone["n_chars"] == 44


def test_digests_that_sets_share_are_kept_once(spark):
    rows = [(0, [1, 2, 3, 4], [1, 2, 5, 6, 9], [5, 6, 7, 8]), (1, [], [], []), (2, [1], [1], [1]), (3, [1, 2], [3], [3, 4]), (4, [], [7], [])]
    kept = X.in_parts(spark.createDataFrame(rows, "k long, own_set array<long>, edited_set array<long>, next_set array<long>"))
    sizes = {r["k"]: sum(len(r[c]) for c in X.PARTS) for r in kept.collect()}
    assert sizes == {0: 9, 1: 0, 2: 2, 3: 4, 4: 1}  # not 13, 0, 3, 5, 1
    got = kept.select("k", *[F.sort_array(c).alias(n) for c, n in zip(X.whole_sets(), ("own", "edited", "following"), strict=True)]).collect()
    assert sorted((r["k"], r["own"], r["edited"], r["following"]) for r in got) == rows
