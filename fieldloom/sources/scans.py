"""Scans of files: listings, fixed-width records, raw video, meshes and point records, result files; a cached table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .containers import metric_name, ms_ssim_db

# File name endings of pictures and raw videos.
PICTURES = ("jpg", "jpeg", "png", "ppm", "pgm", "bmp", "tif", "tiff", "webp")
VIDEOS = ("yuv", "y4m", "rgb")
MOST_VALUES = 1 << 18  # sent at a time by a scan


def listed(spark: SparkSession, root: str, endings: tuple[str, ...] = PICTURES, deep: bool = True) -> DataFrame:
    """(path, length, content) of the files under ``root`` with one of the endings; a missing folder raises. Names are sorted by whoever shows them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(root)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(ending.isin(*endings)).select("path", "length", "content")


def pictures(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(path, height, width, channels, data) of the pictures right under root/split, decoded by Spark's image source."""
    images = spark.read.format("image").option("dropInvalid", "true").load(f"{root}/{split}")
    return images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def fixed_records(files: DataFrame, dtype: str, count: int) -> DataFrame:
    """(path, record, values) of ``files`` (path, content): each ``count`` numbers of ``dtype`` are a record; a rest is left out, and null content gives no rows.

    Records go out some ``MOST_VALUES`` numbers at a time: a long file in parts, short ones together.
    """
    kind, size = np.dtype(dtype), np.dtype(dtype).itemsize * count
    most = max(1, MOST_VALUES // count)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[int, int, np.ndarray]] = []  # row, first record, numbers
            held = 0
            for row, content in enumerate(batch.column(1)):
                raw = content.as_buffer()
                at, n = 0, raw.size // size
                while at < n:
                    taken = min(most - held, n - at)
                    parts.append((row, at, np.frombuffer(raw, kind, taken * count, at * size)))
                    at, held = at + taken, held + taken
                    if held == most:
                        yield records_of(batch.column(0), parts, count)
                        parts, held = [], 0
            if parts:
                yield records_of(batch.column(0), parts, count)

    named = files.where(F.col("content").isNotNull()).select("path", "content")
    return named.mapInArrow(task, f"path {dict(files.dtypes)['path']}, record long, values array<double>")


def records_of(paths: pa.Array, parts: list[tuple[int, int, np.ndarray]], count: int) -> pa.RecordBatch:
    """(path, record, values) of ``parts``: a path's place, the first record's number, all numbers."""
    lengths = np.array([len(values) // count for _, _, values in parts])
    before = np.cumsum(lengths) - lengths
    record = np.arange(lengths.sum()) + np.repeat([at for _, at, _ in parts] - before, lengths)
    values = pa.array(np.concatenate([values for _, _, values in parts]).astype(float))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, count, dtype=np.int32)), values)
    named = paths.take(pa.array(np.repeat([row for row, _, _ in parts], lengths)))
    return pa.RecordBatch.from_arrays([named, pa.array(record), lists], ["path", "record", "values"])


# How much smaller the chroma planes are, by format.
CHROMA = {"400": None, "420": (2, 2), "422": (1, 2), "444": (1, 1)}


def plane_sizes(height: int, width: int, chroma: str) -> list[tuple[str, int, int]]:
    """(plane, height, width) in file order; an odd side's half is rounded up."""
    small = CHROMA[chroma]
    planes = [("y", height, width)]
    return planes if small is None else planes + [(p, -(-height // small[0]), -(-width // small[1])) for p in ("u", "v")]


def video_planes(files: DataFrame, height: int, width: int, chroma: str = "420", bits: int = 8) -> DataFrame:
    """(path, frame, plane, rows, columns, values) of headerless planar video in ``files`` (path, content), a row for each plane of each whole frame."""
    planes = plane_sizes(height, width, chroma)
    records = fixed_records(files, "<u1" if bits <= 8 else "<u2", sum(h * w for _, h, w in planes))
    parts, at = [], 0
    for name, h, w in planes:
        parts.append(F.struct(F.lit(name).alias("plane"), F.lit(h).alias("rows"), F.lit(w).alias("columns"), F.slice("values", at + 1, h * w).alias("values")))
        at += h * w
    return records.select("path", F.col("record").alias("frame"), F.explode(F.array(*parts)).alias("p")).select("path", "frame", "p.*")


def plane_cells(planes: DataFrame) -> DataFrame:
    """(path, frame, plane, h, w, v): a row for each cell."""
    cells = planes.select("path", "frame", "plane", "columns", F.posexplode("values").alias("i", "v"))
    return cells.select("path", "frame", "plane", F.floor(F.col("i") / F.col("columns")).alias("h"), (F.col("i") % F.col("columns")).cast("long").alias("w"), "v")


def labelled_points(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, pos, x, y, z, remission, label, instance): records of four floats and, by place, of two 16-bit numbers of a side file; a file without its side file gives no rows."""
    p = fixed_records(points, "<f4", 4).withColumnRenamed("record", "pos")
    s = fixed_records(labels, "<u2", 2).select("path", F.col("record").alias("pos"), F.col("values").alias("side"))
    names = ("x", "y", "z", "remission")
    return p.join(s, ["path", "pos"]).select("path", "pos", *[F.col("values")[i].alias(c) for i, c in enumerate(names)], F.col("side")[0].cast("long").alias("label"), F.col("side")[1].cast("long").alias("instance"))


def mesh_path_facts(path: Column) -> list[Column]:
    """label, split and number of a mesh file named …/label/split/label_number.off; null where the path is another."""
    pattern = r"([^/]+)/(train|test)/\1_(\d+)\.off$"
    part = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))
    return [part(1).alias("label"), part(2).alias("split"), part(3).cast("long").alias("number")]


def mesh_corners(files: DataFrame) -> DataFrame:
    """(path, vertex, x, y, z) of meshes in ``files`` (path, text): a line OFF, the counts, then a line for each vertex; the counts may stand on the first line."""
    lines = F.filter(F.split(F.regexp_replace("text", r"^\s*OFF[ \t]*\n?", ""), r"\s*\n\s*"), lambda s: (s != "") & ~s.startswith("#"))
    counted = files.withColumn("_lines", lines).withColumn("_n", F.split(F.element_at("_lines", 1), r"\s+")[0].cast("int"))
    rows = counted.select("path", F.posexplode(F.slice("_lines", F.lit(2), F.col("_n"))).alias("vertex", "line"))
    at = F.split(F.trim("line"), r"\s+")
    return rows.select("path", F.col("vertex").cast("long").alias("vertex"), *[at[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def zipped(rows: DataFrame, *arrays: str) -> DataFrame:
    """``rows`` with the arrays side by side: ``i`` and a column for each; arrays of different lengths raise."""
    sizes = [F.size(a) for a in arrays]
    equal = sizes[0] == sizes[0]
    for s in sizes[1:]:
        equal = equal & (s == sizes[0])
    pairs = F.when(equal, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays differ in length")))
    rest = [c for c in rows.columns if c not in arrays]
    return rows.select(*rest, F.posexplode(pairs).alias("i", "_z")).select(*rest, F.col("i").cast("long").alias("i"), "_z.*")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where there is none, ``make`` is asked for it once and it is written there. Another failure to read is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------- result files
def write_results(records: DataFrame, path: str) -> None:
    """A folder for each record of ``records`` (name, json), with its text."""
    records.select("name", "json").write.partitionBy("name").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(name, metric, i, value) of result files, a folder for each name: arrays by metric, right at the top or under ``results``.

    Short names of metrics are made full, and structural similarity is given in
    decibels. What is no array is left out.
    """
    texts = spark.read.schema("value string, name string").option("wholetext", "true").text(path)
    inner = F.from_json("value", "struct<results: map<string, array<double>>>")["results"]
    metrics = F.coalesce(inner, F.from_json("value", "map<string, array<double>>"))
    rows = texts.select("name", F.explode(metrics).alias("metric", "values")).select("name", metric_name(F.col("metric")).alias("metric"), F.posexplode("values").alias("i", "value"))
    value = F.when(F.col("metric").startswith("ms-ssim"), ms_ssim_db(F.col("value"))).otherwise(F.col("value"))
    return rows.select("name", "metric", F.col("i").cast("long").alias("i"), value.alias("value"))


def run_means(rows: DataFrame) -> DataFrame:
    """(metric, i, mean, runs): each metric's mean over all names at each setting."""
    return rows.groupBy("metric", "i").agg(F.avg("value").alias("mean"), F.count("*").alias("runs"))


BENCHMARK = "dataset string, quality int, sweep string, bpp double, psnr double"


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows of CSV files with a header, typed; of rows that repeat (dataset, quality, sweep) one, and a row without one of them raises."""
    rows = spark.read.schema(BENCHMARK).option("header", "true").option("mode", "FAILFAST").csv(path)
    keys = ("dataset", "quality", "sweep")
    known = F.when(sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) == 0, F.col("dataset")).otherwise(F.raise_error(F.lit("a benchmark row without its key")))
    return rows.withColumn("dataset", known).dropDuplicates(list(keys))
