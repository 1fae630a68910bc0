import re

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import pii as P

TEXT = "Mr. John Smith and Mrs Anna Smith: a.b7@X.com, A.B7@x.com; 10.2.3.4, 4111 1111 1111 1111, 5105105105105101 +1 (643)%%% 555-5742### token = \"73d74656391396c3efc1d06034ff67f14d7a0891\" Господин Иван Петров. Smith says 1.2.3."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, 7), (2, "mail A.B7@X.COM or c.d@x.com from 10.2.3.4 and 10.2.3.5", 7), (3, None, 7), (4, "", 7), (5, "nothing here, 12 items at 3.5", 7), (5, "nothing here, 12 items at 3.5", 7), (None, "call 555-123-4567 " + "x " * 50_000 + "me@here.org", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_email int")


@pytest.fixture(scope="module")
def got(docs):
    return P.surrogates(docs).collect()


def test_entities_are_replaced_by_their_kind(got):
    first = next(r for r in got if r["doc_id"] == 1)
    assert (first["n_name"], first["n_email"], first["n_ip"], first["n_card"], first["n_phone"], first["n_key"]) == (3, 2, 1, 1, 1, 1)
    text = first["text"]
    for gone in ("John", "Smith and", "a.b7@X.com", "10.2.3.4", "4111 1111", "555-5742", "73d7465639", "Иван", "Петров"):
        assert gone not in text
    m = re.fullmatch(r"Mr\. (\w+) (\w+) and Mrs (\w+) (\w+): (\S+), (\S+); ([\d.]+), (4\d{3} \d{4} \d{4} \d{4}), (5105105105105101) (\+1 \(\d{3}\)%%% \d{3}-\d{4})### token = \"([0-9a-f]{40})\" Господин ([а-яА-Я]+) ([а-яА-Я]+)\. Smith says 1\.2\.3\.", text)
    assert m
    assert m[2] == m[4]  # one family
    assert m[5].lower() == m[6].lower()  # one address
    luhn = lambda s: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s.replace(" ", "")))) % 10
    assert luhn(m[8]) == 0 and luhn("4111111111111111") == 0
    assert m[1].lower().endswith(tuple(P.ENDINGS["latin", "male"])) and m[3].lower().endswith(tuple(P.ENDINGS["latin", "female"]))


def test_the_same_in_all_documents_and_distinct(got):
    one, two = (next(r for r in got if r["doc_id"] == k)["text"] for k in (1, 2))
    mail = re.findall(r"\S+@[\w.]+\w", one)[1].lower()
    told = re.findall(r"\S+@[\w.]+\w", two)
    assert told[0].lower() == mail and told[1].lower() != mail
    assert re.findall(r"\d+\.\d+\.\d+\.\d+", two)[0] in one
    assert len(set(re.findall(r"\d+\.\d+\.\d+\.\d+", two))) == 2


def test_other_rows_stay(got, docs):
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[3]["text"] is None and by[4]["text"] == "" and by[3]["n_entities"] == by[4]["n_entities"] == 0
    assert by[5]["text"] == "nothing here, 12 items at 3.5"
    assert by[None]["n_entities"] == 2 and by[None]["text"].count("x ") == 50_000 and "me@here.org" not in by[None]["text"]


def read_names(spark, rows):
    got = P.surrogates(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: r["text"] for r in got.collect()}


def test_collisions_draw_again_until_none_is_left(spark, monkeypatch):
    monkeypatch.setattr(P, "FIXED_FORM", 2)
    monkeypatch.setattr(P, "byte", lambda h, i: F.pmod(F.conv(F.substring(h, 1, 2), 16, 10).cast("int"), F.lit(3)) + i * 0)  # three different draws of each form
    rows = [(i, f"from 10.0.{i}.1 on") for i in range(12)] + [(100 + i, f"call 555-123-45{i + 10}") for i in range(12)]
    got = read_names(spark, rows)
    assert len(set(got.values())) == 24 and not set(got.values()) & {t for _, t in rows}


def test_short_and_full_mentions_agree_after_redraws(spark, monkeypatch):
    monkeypatch.setattr(P, "byte", lambda h, i: F.pmod(F.conv(F.substring(h, 1, 2), 16, 10).cast("int"), F.lit(4)) + i * 0)
    rows = [(i, f"Mr. {g} Fam{chr(97 + i)} met Mrs Fam{chr(97 + i)} and Dr {g} Fam{chr(97 + i)}") for i, g in enumerate("Abel Bert Carl Dirk Emil Fred Gerd Hans Igor Jens".split())]
    seen = set()
    for text in read_names(spark, rows).values():
        m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) and Dr (\w+) (\w+)", text)
        assert m and m[2] == m[3] == m[5] and m[1] == m[4]
        seen.add((m[1], m[2]))
    assert len({g for g, _ in seen}) == len({f for _, f in seen}) == 10


def test_many_names_stay_distinct(spark):
    """300,000 made-up family names, each told from all others by its surrogate, by brute force over the draws."""
    from pyspark.sql import Row

    letters = lambda n: F.concat(*[F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.floor(n / 26**k) % 26 + 1).cast("int"), F.lit(1)) for k in range(4)])
    found = spark.range(300_000, numPartitions=8).select(F.lit("family").alias("kind"), letters(F.col("id")).alias("plain"), F.lit("either").alias("gender")).withColumn("value", F.initcap("plain"))
    other = P.exceptions(found, "k")
    drawn = found.drop("gender").join(other, ["kind", "plain"], "left").withColumn("s", P.surrogate(F.col("value"), F.col("kind"), "k", F.coalesce("attempt", F.lit(0)), F.lit("either")))
    assert drawn.agg(F.count_distinct("s").alias("n")).first() == Row(n=300_000)


def test_signs_that_mark_mentions_stay(spark):
    text = "\x01a@b.org\x02 and \x02\x01 or \x02\x03\x01"
    out = read_names(spark, [(1, text), (2, "\x01\x02")])
    assert re.fullmatch(r"\x01\w+@\w+\.example\.org\x02 and \x02\x01 or \x02\x03\x01", out[1]) and out[2] == "\x01\x02"


def test_layouts_of_one_number_agree(spark):
    out = read_names(spark, [(1, "+1 (643) 555-5742"), (2, "+1 643 555 5742"), (3, "4111 1111 1111 1111"), (4, "4111111111111111")])
    plain = {k: re.sub(r"\D", "", t) for k, t in out.items()}
    assert plain[1] == plain[2] and plain[3] == plain[4] and plain[1] != "16435555742"


def test_no_documents(no_docs):
    assert P.surrogates(no_docs.select("doc_id", "text")).count() == 0


def test_other_keys_give_other_surrogates(docs):
    a, b = (P.surrogates(docs.where("doc_id = 2"), key=k).first()["text"] for k in ("one", "two"))
    assert a != b
