"""Queries over the driver's tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import token_codes

    return token_codes(table(spark, sf_dir, "documents"), tokenizer_path())


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminations

    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixture import mix

    return mix(table(spark, sf_dir, "documents")).drop("row_key")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_conversations

    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_conversations(format_conversations(turns))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import version_fingerprints

    return version_fingerprints(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (their source is the host) and pages, whose rows have a null ``doc_id``, under one set of host priors.

    Ids are passed through with their rows: a document and a page with one id are
    two rows, and so are rows that share an id or have none.
    """
    from pyspark.sql import functions as F

    from . import language as L

    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none, no_id = F.lit(None).cast("string"), F.lit(None).cast("long")
    of_docs = docs.select("doc_id", no_id.alias("page_id"), F.col("source").alias("host"), none.alias("markup"), none.alias("address"), "text")
    of_pages = pages.select(no_id.alias("doc_id"), "page_id", L.host_of(F.col("url")).alias("host"), L.declared_by(F.col("html")).alias("markup"), L.address_language(F.col("url")).alias("address"), L.visible(F.col("html")).alias("text"))
    return L.identify(of_docs.unionAll(of_pages), L.fit(docs))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .near_duplicates import near_duplicates

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_key"), "text")
    found = near_duplicates(docs, shingle_words=2, num=80, den=100)
    return found.select(F.col("row_key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import surrogates

    return surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


# op3 by its contract; the lengths are those of the template's markers, and each control string or escape sign adds one sign
OP3_SQL = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER w - 1 AS k, lag(role) OVER w AS last,
  length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?SYS>>|\[ROLE\]|\[/?TEXT\]'))
  + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 18 ELSE 23 + length(role) END AS size
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
a AS (SELECT *, CASE WHEN last IS NULL THEN role IN ('system', 'user') WHEN last = 'system' THEN role = 'user' WHEN last = 'user' THEN role = 'assistant'
  WHEN last = 'assistant' THEN role IN ('user', 'tool') WHEN last = 'tool' THEN role = 'assistant' ELSE false END AS allowed FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars, bool_and(allowed) AND arg_max(role, k) = 'assistant' AS valid, min(k) FILTER (NOT allowed) AS first_refused
FROM a GROUP BY conv_id
"""

# op6 by its contract: all pairs that share a shingle, then reachability
OP6_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM sets JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL by the contracts of op3 and op6; the other operators train, tokenize, parse or draw what SQL can't."""
    return {"op3_chat_format": OP3_SQL, "op6_near_duplicates": OP6_SQL}
