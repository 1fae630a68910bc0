"""Byte headers, length-prefixed bodies, raw fields and result records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def packed_header(model: Column, metric: Column, quality: Column) -> Column:
    """Two bytes: the model's number, then four bits of the metric's and four of the quality less one."""
    second = F.shiftleft(metric.cast("int"), 4).bitwiseOR((quality - 1).cast("int"))
    return F.unhex(F.concat(F.lpad(F.hex(model.cast("long")), 2, "0"), F.lpad(F.hex(second.cast("long")), 2, "0")))


def header_fields(header: Column) -> list[Column]:
    """model, metric, quality of a packed header."""
    byte = lambda i: F.conv(F.substring(F.hex(header), 2 * i + 1, 2), 16, 10).cast("int")
    return [byte(0).cast("long").alias("model"), F.shiftright(byte(1), 4).cast("long").alias("metric"), (byte(1).bitwiseAND(15) + 1).cast("long").alias("quality")]


def uint32(x: Column) -> Column:
    """Four bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 8, "0"))


def packed_body(h: Column, w: Column, parts: list[Column]) -> Column:
    """Height, width, the number of parts, then each part's length and bytes."""
    sized = [x for p in parts for x in (uint32(F.octet_length(p)), p.cast("binary"))]
    return F.concat(uint32(h), uint32(w), uint32(F.lit(len(parts))), *sized)


def number(raw: Column, at: Column, size: int) -> Column:
    """The unsigned number in ``size`` bytes from place ``at`` (0 is the first), the highest byte first."""
    return F.conv(F.hex(F.substring(raw, at + 1, F.lit(size))), 16, 10).cast("long")


def body_fields(body: Column) -> list[Column]:
    """h, w and parts (an array of bytes) of a packed body; one whose bytes end before its parts raises."""
    state = F.struct(F.lit(12).cast("long").alias("at"), F.array().cast("array<binary>").alias("parts"))

    def step(s: Column, _: Column) -> Column:
        size = number(body, s["at"], 4)
        part = F.when(s["at"] + 4 + size <= F.octet_length(body), F.substring(body, s["at"] + 5, size)).otherwise(F.raise_error(F.lit("a body that ends too soon")).cast("binary"))
        return F.struct((s["at"] + 4 + size).alias("at"), F.concat(s["parts"], F.array(part)).alias("parts"))

    n = number(body, F.lit(8), 4)
    walked = F.aggregate(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")), state, step)
    return [number(body, F.lit(0), 4).alias("h"), number(body, F.lit(4), 4).alias("w"), walked["parts"].alias("parts")]


MAGIC = "534C"


def packed_planes(width: Column, height: Column, depth: Column, channels: Column, symbols: Column, bits: Column, payload: Column) -> Column:
    """A mark, three 16-bit sizes, channels and symbols in 16 bits each, the bits of activations in 8, then the payload."""
    two = lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")
    head = F.concat(F.lit(MAGIC), *[two(x) for x in (width, height, depth, channels, symbols)], F.lpad(F.hex(bits.cast("long")), 2, "0"))
    return F.concat(F.unhex(head), payload.cast("binary"))


def plane_fields(raw: Column) -> list[Column]:
    """width, height, depth, channels, symbols, bits and payload of ``packed_planes``; other bytes raise."""
    known = F.when(F.hex(F.substring(raw, 1, 2)) == MAGIC, raw).otherwise(F.raise_error(F.lit("not a container of planes")).cast("binary"))
    sizes = [number(known, F.lit(2 + 2 * i), 2).alias(c) for i, c in enumerate(("width", "height", "depth", "channels", "symbols"))]
    return [*sizes, number(known, F.lit(12), 1).alias("bits"), F.substring(known, F.lit(14), F.octet_length(known)).alias("payload")]


def laid_out(chunks: DataFrame, by: str) -> DataFrame:
    """(by, offsets, payload) of ``chunks`` (by, chunk, bytes): the chunks end to end in order, and where each begins. A group is one container."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "bytes")))
    packs = chunks.groupBy(by).agg(ordered.alias("c"))
    sizes = F.transform("c", lambda x: F.octet_length(x["bytes"]).cast("long"))
    offsets = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), lambda t, x: t + x))
    return packs.select(by, offsets.alias("offsets"), F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["bytes"])), "")).alias("payload"))


def chunk_of(payload: Column, offsets: Column, k: Column) -> Column:
    """Chunk ``k`` of a payload, by its offset alone."""
    end = F.coalesce(F.get(offsets, k + 1), F.octet_length(payload).cast("long"))
    return F.substring(payload, F.get(offsets, k) + 1, end - F.get(offsets, k))


def stream_sizes(packs: DataFrame, by: str, streams: str) -> DataFrame:
    """(by, stream, size) of packs with a map of streams to lists of byte strings: each stream's bytes, each pack's (null stream) and all (null key)."""
    each = packs.select(by, F.explode(streams).alias("stream", "parts"))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda t, x: t + F.octet_length(x))
    return each.withColumn("size", size).rollup(by, "stream").agg(F.sum("size").alias("size"))


def decoded_field(files: DataFrame, shape: tuple[int, int, int], dtype: str = "<f4", short: bool = False) -> DataFrame:
    """(path, n, h, w, v) of headerless binary fields in ``files`` (path, content): the first n*h*w values of each. Fewer raise; with ``short`` a file gives the whole slices that it has."""
    from .scans import fixed_records

    n, h, w = shape
    size = n * np.dtype(dtype).itemsize * h * w
    held = F.coalesce(F.octet_length("content"), F.lit(0))
    told = F.concat(F.col("path").cast("string"), F.lit(": "), held.cast("string"), F.lit(f" bytes are too few for {shape}"))
    content = F.substring("content", 1, size)
    if not short:
        content = F.when(held < size, F.raise_error(told).cast("binary")).otherwise(content)
    slices = fixed_records(files.select("path", content.alias("content")), dtype, h * w)
    cells = slices.select("path", F.col("record").alias("n"), F.posexplode("values").alias("i", "v"))
    return cells.select("path", "n", F.floor(F.col("i") / w).alias("h"), (F.col("i") % w).cast("long").alias("w"), "v")


def raw_field(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "<f4") -> DataFrame:
    """``decoded_field`` of the files at ``path``, each read whole by Spark's binary source (2 GB at most)."""
    return decoded_field(spark.read.format("binaryFile").load(path), shape, dtype)


def result_rows(records: DataFrame) -> DataFrame:
    """(name, metric, i, value) from records (name, results: map of arrays), one row per value."""
    return records.select("name", F.explode("results").alias("metric", "values")).select("name", "metric", F.posexplode("values").alias("i", "value"))


def result_records(rows: DataFrame) -> DataFrame:
    """The inverse: values in the order of ``i``."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))), lambda x: x["value"])
    lists = rows.groupBy("name", "metric").agg(ordered.alias("values"))
    return lists.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("metric", "values"))).alias("results"))


def metric_name(metric: Column) -> Column:
    """The full name of a metric; unknown ones stay."""
    return F.when(metric.isin("psnr", "ms-ssim"), F.concat(metric, F.lit("-rgb"))).otherwise(metric)


def ms_ssim_db(x: Column) -> Column:
    return -10 * F.log10(F.nullif(1 - x, F.lit(0.0)))


def content_sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)
