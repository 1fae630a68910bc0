"""What several of the operators share: tables in the shared folder, digests of rows, joins that spread heavy keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept as cut
from ..session import new_path, sent_whole

__all__ = ["cut", "dropped", "joined_evenly", "let", "new_table", "release", "row_digest", "sent_whole", "shuffles_let_go", "small_batches", "text_or_empty", "written"]
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 250
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WRITTEN: list[str] = []  # tables that this driver wrote to the shared folder, for ``release``


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Python tasks that run within take at most ``rows`` rows at a time.

    Whole texts and sets can be long: buffers on both sides of the pipe grow with
    the rows of a batch, and the JVM keeps the largest that it has had.
    """
    before = spark.conf.get(BATCH_SETTING)
    if not 0 < int(before) <= rows:
        spark.conf.set(BATCH_SETTING, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept within let go of their shuffle files as soon as they are made.

    Else these stay until the driver happens to collect its garbage, which a large
    heap does late.
    """
    before = spark.conf.get(CLEANUP_SETTING)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_SETTING, before)


def new_table(spark: SparkSession) -> str:
    """The path of a new table in the shared folder."""
    WRITTEN.append(new_path(spark, "tables"))
    return WRITTEN[-1]


def release(spark: SparkSession) -> None:
    """Deletes the tables that operators wrote to the shared folder; results that still read them can't be used after it."""
    while WRITTEN:
        delete(spark, WRITTEN.pop())


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Deletes the table that ``written`` made for ``df``, which nothing reads any more: what came from it is kept."""
    folders = {path.rsplit("/", 1)[0].rsplit("/", 1)[-1] for path in df.inputFiles()}
    for path in [p for p in WRITTEN if p.rsplit("/", 1)[-1] in folders]:
        WRITTEN.remove(path)
        delete(df.sparkSession, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table to the shared folder and read again."""
    spark = df.sparkSession
    path = new_table(spark)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    """The column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_digest(*columns: str) -> Column:
    """128 bits that tell a row by ``columns``; null differs from every value, and no two rows run into each other."""
    told = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*told)))


def joined_evenly(rows: DataFrame, table: DataFrame, key: str, spread: str, counted: DataFrame, most: int = 256, most_heavy: int = 1_000_000) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, a key of over ``most`` rows dealt out by ``spread`` to as many copies of its entry.

    Keys are counted in ``counted``, which has the rows' keys and is kept. Rows of
    other keys are joined plainly. Only the heavy keys' counts are sent whole, under
    a bound.
    """
    heavy = counted.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    heavy = cut(heavy.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
    if heavy.isEmpty():
        return rows.join(table, key)
    heavy = sent_whole(heavy, most_heavy)
    dealt = rows.join(heavy, key).withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")).drop("_parts")
    copies = table.join(heavy, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    light = rows.join(heavy, key, "left_anti").join(table, key)
    return light.unionByName(dealt.join(copies, [key, "_part"]).drop("_part"))


def let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
