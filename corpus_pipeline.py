"""From raw documents to token files in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a table; all but
the last return the columns of ``docs``. ``run`` writes each stage's result to
the shared folder and reads it again before the next. SQL can't express trained
trigram models, sketches, tilings or tokenizers, so there is no ``ORACLE_SQL``;
the tests hold every stage against a plain version. Column names that begin with
``_fl_`` are reserved; other extra columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, language, mixture, near_duplicates
from fieldloom.llm.codes import token_codes
from fieldloom.llm.common import row_digest, written
from fieldloom.llm.queries import tokenizer_path

MAX_REPEATS = 1.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels know; the others go. A document's source is its host.

    A verdict rests on source and text, so rows that share both share it.
    """
    none, key = F.lit(None).cast("string"), row_digest("source", "text")
    rows = docs.select(key.alias("_fl_refused"), F.col("source").alias("host"), none.alias("markup"), none.alias("address"), "text")
    refused = language.identify(rows, language.fit(docs)).where(~F.col("accepted")).select("_fl_refused").distinct()
    return docs.join(refused, key == F.col("_fl_refused"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; of rows that are the same, one.

    Rows without an id come after all others. Rows are told by id and text.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), row_digest("text").alias("text"))
    found = near_duplicates.near_duplicates(docs.select(key.alias("row_key"), "text"))
    kept = found.where("kept").select(F.col("row_key").alias("_fl_kept")).distinct()
    rows = docs.withColumn("_fl_key", key)
    return rows.join(kept, F.col("_fl_key") == F.col("_fl_kept"), "left_semi").dropDuplicates(["_fl_key"]).select(*docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(docs, benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources reads it, once at least."""
    return mixture.mixed_documents(docs, max_repeats=MAX_REPEATS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in ascending id order, and what is read back from them."""
    return token_codes(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("mixture", mix_sources),
    ("tokens", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
