import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a long one, repeated rows, null ids, columns with clashing names."""
    long_text = " ".join(f"word{i % 997} number{i}." for i in range(30_000))
    rows = [(1, "Plain text here.\nAnd more of it, to be sure.", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "  \n\t ", "de", None), (5, long_text, "en", "a"), (6, "Plain text here.\nAnd more of it, to be sure.", "en", "b"), (7, "tie", "en", "b"), (7, "tie", "en", "b"), (None, "no id at all", "en", "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 0.5, 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, block int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
