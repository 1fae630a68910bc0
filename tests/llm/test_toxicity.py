import zlib

import pytest

from fieldloom.llm import toxicity as T
from fieldloom.llm.queries import op7_toxicity


def test_spellings():
    assert T.plain_word("!!Id1ot###") == ("idiot", True)
    assert T.plain_word("idiot,") == ("idiot", False)
    assert T.plain_word("2024") == ("", False)
    assert T.document_terms("Idiot") == {"^idio", "^idiot", "^idiot$"}


@pytest.fixture(scope="module")
def scored(spark):
    out = op7_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().groupby("doc_id")["toxic"].max()
    return out.assign(label=out["doc_id"].map(labels))


def test_held_out_rows(scored):
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(scored["doc_id"], scored["held_out"], strict=True))
    assert scored["score"].between(0, 1).all() and ((scored["score"] >= 0.5) == (scored["predicted"] == 1)).all()
    held = scored[scored["held_out"] & scored["label"].notna()]
    pos, neg = held[held["label"] == 1]["score"].to_numpy(), held[held["label"] == 0]["score"].to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.85
    assert (held["predicted"] == held["label"]).mean() > 0.93


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert T.fit(odd_docs, labels.where("false")) is None
    got = T.score(odd_docs, None)
    assert got.count() == odd_docs.count() and {r["score"] for r in got.collect()} == {0.0}
    rows = [(i, ("you are scum " if i % 2 else "a fine day ") + f"word{i % 5} " * (i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    again = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    assert all((r["predicted"] == 1) == bool(i % 2) for i, r in again.items())
    odd = T.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert T.score(no_docs, model).count() == 0
