"""Stand-ins for fields, symbols, clouds and sweeps, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as slices of 8 by 8 cells: (n, h, w, v, label)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), "label", F.posexplode("embedding").alias("i", "v"))
    return rows.select("n", F.floor(F.col("i") / 8).cast("long").alias("h"), (F.col("i") % 8).cast("long").alias("w"), F.col("v").cast("double").alias("v"), "label")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of embeddings as points, a cloud for each label."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("cloud"), F.col("vec_id").alias("p"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as symbol streams, one for each return flag: (stream, sym)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stream"), F.col("l_quantity").cast("long").alias("sym"))


def reconstructed(spark: SparkSession, sf_dir: str, levels: int = 255) -> DataFrame:
    """The field with ``r``: each slice scaled to 0..1, rounded to ``levels`` steps and scaled back."""
    from ..operators.fields import denormalized, normalize

    return normalize(field(spark, sf_dir)).withColumn("r", denormalized(F.rint(F.col("x") * levels) / levels))
