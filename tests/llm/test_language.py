import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import language as L

WORDS = {"en": "the house and that with this other from have been".split(), "de": "das haus und nicht wenn dieser andere von haben gewesen".split(), "fr": "la maison avec cette autre depuis avoir été même où".split()}


def say(lang, k, n=30):
    w = WORDS[lang]
    return " ".join(w[(k * 7 + i * i + 3 * i) % len(w)] for i in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(say(lang, k), lang) for lang in WORDS for k in range(60)]
    return L.fit(spark.createDataFrame(rows, "text string, lang string"))


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "row_key long, text string, host string, markup string, address string")


def test_text_decides(spark, model):
    rows = rows_of(spark, [(i, say(lang, i + 100), f"h{i}", None, None) for i, lang in enumerate(["en", "de", "fr"] * 5)])
    got = {r["row_key"]: r["language"] for r in L.identify(rows, model).collect()}
    assert got == {i: lang for i, lang in enumerate(["en", "de", "fr"] * 5)}


def test_evidence_adds_up(spark, model):
    short = "au"  # letters that say little
    rows = rows_of(spark, [(1, short, "x", None, None), (2, short, "x", "de", None), (3, short, "x", "fr", "fr"), (4, short, "fr.example", None, None), *[(10 + i, say("fr", i), "fr.example", None, None) for i in range(20)]])
    got = {r["row_key"]: r for r in L.identify(rows, model, accept=0.0).collect()}
    assert got[3]["language"] == "fr"
    assert got[4]["language"] == "fr"  # its host speaks French
    fr = lambda key: got[key]["confidence"] if got[key]["language"] == "fr" else 0.0
    assert fr(3) > fr(1) and fr(4) > fr(1)


def test_addresses_and_markup(spark):
    rows = [("https://u@m.shop.example.de:80/x?lang=1", '<HTML  class=a lang="FR-ca">'), ("http://a.example.com/es/12", "<html lang=en>"), (None, None), ("no address", "<p lang='fr'>")]
    df = spark.createDataFrame(rows, "url string, html string").select(L.host_of(F.col("url")), L.address_language(F.col("url")), L.declared_by(F.col("html")), L.domain_of(L.host_of(F.col("url"))))
    assert [tuple(r) for r in df.collect()] == [("m.shop.example.de", "de", "fr", "example.de"), ("a.example.com", "es", "en", "example.com"), ("", None, None, ""), ("", None, None, "")]


def test_odd_tables(spark, odd_docs, no_docs, model):
    shape = lambda d: d.select(F.xxhash64("doc_id", "text").alias("row_key"), "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("markup"), F.lit(None).cast("string").alias("address"))
    got = L.identify(shape(odd_docs), model)
    assert got.count() == odd_docs.count()
    assert L.identify(shape(no_docs), model).count() == 0
    nothing = L.fit(no_docs)
    assert nothing.languages == [L.NONE]
    assert not any(r["accepted"] for r in L.identify(shape(odd_docs), nothing).collect())
    silent = rows_of(spark, [(1, "123 !!", "h", None, None), (2, "", "h", "en", None), (3, None, None, None, None), (4, "кириллица и ещё слова " * 5, "h", None, None)])
    assert {r["language"] for r in L.identify(silent, model).collect()} == {L.NONE}


def test_query_tells_documents_from_pages(spark, tmp_path):
    from fieldloom.llm.queries import op5_language

    docs = [(k, say("de" if k < 20 else "en", k), "de" if k < 20 else "en", "books") for k in range(40)]
    docs += [(50, say("de", 50), "de", "books"), (50, say("en", 51), "en", "books"), (None, say("de", 52), "de", "books"), (None, say("en", 53), "en", "books")]
    pages = [(k, f"http://h{k}.example/", f"<p>{say('en' if k < 20 else 'de', k + 100)}</p>") for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((str(r["doc_id"]), str(r["page_id"]), r["language"]) for r in op5_language(spark, str(tmp_path)).collect())
    want = [(str(r[0]), "None", r[2]) for r in docs] + [("None", str(r[0]), "en" if r[0] < 20 else "de") for r in pages]
    assert got == sorted(want)


def plain_fusion(rows, model):
    """Bayes' rule by hand over all rows (text, host, markup, address): each row's language and its confidence."""
    names, k = model.languages, len(model.languages) - 1

    def normal(scores):
        top = max(scores)
        powers = [math.exp(x - top) for x in scores]
        return [p / sum(powers) for p in powers]

    def host_parts(host):
        return host, ".".join(host.split(".")[-2:])

    evidence = [model.evidence(t or "") for t, *_ in rows]
    own = [normal(ll)[:k] if n else [0.0] * k for ll, n in evidence]
    hosts, domains = defaultdict(lambda: [0.0] * k), defaultdict(lambda: [0.0] * k)
    for (_, host, *_), p in zip(rows, own, strict=True):
        for table, key in zip((hosts, domains), host_parts(host or ""), strict=True):
            table[key] = [a + b for a, b in zip(table[key], p, strict=True)]
    everywhere = [sum(h[i] for h in hosts.values()) + 1 for i in range(k)]
    root = [x / sum(everywhere) for x in everywhere]
    out = []
    for (_, host, markup, address), (ll, n), p in zip(rows, evidence, own, strict=True):
        h, d = host_parts(host or "")
        hs, ds = ([max(0.0, a - b) for a, b in zip(t, p, strict=True)] for t in (hosts[h], domains[d]))
        prior = [(x + L.DOMAIN_WEIGHT * r) / (sum(ds) + L.DOMAIN_WEIGHT) for x, r in zip(ds, root, strict=True)]
        prior = [(x + L.HOST_WEIGHT * r) / (sum(hs) + L.HOST_WEIGHT) for x, r in zip(hs, prior, strict=True)]
        scores = [math.log(q * 0.98) + ll[i] for i, q in enumerate(prior)] + [math.log(0.02) + ll[k]]
        for said, sure in ((markup, L.MARKUP_RELIABILITY), (address, L.ADDRESS_RELIABILITY)):
            if said in names[:k]:
                scores = [x + (math.log(sure) if names[i] == said else math.log((1 - sure) / max(1, k - 1))) for i, x in enumerate(scores[:k])] + [scores[k] - math.log(k)]
        post = normal(scores)
        best = max(range(k + 1), key=lambda i: (post[i], -i))
        out.append((names[best] if n and post[best] >= L.ACCEPT else L.NONE, post[best] if n else 0.0))
    return out


def test_query_is_the_rule_by_hand(spark):
    from fieldloom.llm.queries import op5_language, table

    sf = "/root/testdata/sf0.001"
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    model = L.fit(docs)
    of_pages = pages.select("page_id", L.visible(F.col("html")).alias("text"), L.host_of(F.col("url")).alias("host"), L.declared_by(F.col("html")).alias("markup"), L.address_language(F.col("url")).alias("address")).collect()
    keys = [(r["doc_id"], None) for r in docs.collect()] + [(None, r["page_id"]) for r in of_pages]
    rows = [(r["text"], r["source"], None, None) for r in docs.collect()] + [tuple(r)[1:] for r in of_pages]
    want = dict(zip(keys, plain_fusion(rows, model), strict=True))
    got = {(r["doc_id"], r["page_id"]): (r["language"], r["confidence"]) for r in op5_language(spark, sf).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in got)
