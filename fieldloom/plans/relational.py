"""Queries on symbols, lookups, points, searches, records and events; each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import coder, entropy, points, search
from ..session import kept, new_path, sent_whole
from ..sources import containers, video
from ..streaming import windows
from .science import rounded
from .tables import cloud, field, symbols, table


# ------------------------------------------------------------------- symbols
def symbol_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(entropy.histogram(symbols(spark, d), "stream"), "p", places=9)


def symbol_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(entropy.entropy(entropy.histogram(symbols(spark, d), "stream"), "stream"), "bits", "bits_per_symbol", places=4)


def smoothed_cdf(spark: SparkSession, d: str) -> DataFrame:
    return entropy.smoothed_cdf(entropy.histogram(symbols(spark, d), "stream"), "stream")


def cdf_prefix(spark: SparkSession, d: str) -> DataFrame:
    hist = entropy.histogram(symbols(spark, d), "stream")
    return entropy.prefix_sums(hist, "stream", "sym", "cells").select("stream", "sym", "before", "through")


def pmf_from_cdf(spark: SparkSession, d: str) -> DataFrame:
    cdf = entropy.smoothed_cdf(entropy.histogram(symbols(spark, d), "stream"), "stream")
    return entropy.differences(cdf, "stream", "sym", "hi").select("stream", "sym", "step")


def bit_cost(spark: SparkSession, d: str) -> DataFrame:
    hist = entropy.histogram(symbols(spark, d), "stream")
    cdf = entropy.smoothed_cdf(hist, "stream")
    cost = F.sum(F.col("cells") * -F.log2((F.col("hi") - F.col("lo")) / 65536.0))
    return rounded(hist.join(cdf, ["stream", "sym"]).groupBy("stream").agg(cost.alias("bits"), F.sum("cells").alias("total")), "bits", places=4)


def quantised_cells(spark: SparkSession, d: str) -> DataFrame:
    return field(spark, d).withColumn("sym", F.rint(F.col("v") * 8).cast("long"))


def context_entropy(spark: SparkSession, d: str) -> DataFrame:
    cells = quantised_cells(spark, d)
    mode = entropy.modes(cells.select(F.lit(0).alias("k"), "sym"), "k").first()["mode"]
    ctx = entropy.spatial_context(cells.withColumn("mode", F.lit(mode)), "mode", 1)
    hist = entropy.histogram(ctx.select("ctx", "sym"), "ctx")
    return rounded(entropy.entropy(hist, "ctx"), "bits", "bits_per_symbol", places=4)


def zero_slices(spark: SparkSession, d: str) -> DataFrame:
    kept = quantised_cells(spark, d).withColumn("sym", F.rint(F.col("v") * 2).cast("long")).groupBy("n").agg(F.sum(F.abs("sym")).alias("mass"))
    return kept.where("mass > 0")


def channel_activity(spark: SparkSession, d: str) -> DataFrame:
    cells = quantised_cells(spark, d).withColumn("c", F.col("h") * 8 + F.col("w"))
    active = cells.join(entropy.modes(cells.select("c", "sym"), "c"), "c").groupBy("c", "label").agg(F.max(F.col("sym") != F.col("mode")).alias("active"))
    share = F.avg(F.col("active").cast("int"))
    return active.groupBy("c").agg(F.greatest(F.lit(1.0), F.least(F.rint(share * 65536), F.lit(65535.0))).cast("long").alias("activity"))


def scale_bucket(spark: SparkSession, d: str) -> DataFrame:
    spread = field(spark, d).groupBy("n").agg((F.stddev_pop("v") * 4).alias("scale"))
    return spread.select("n", F.round("scale", 6).alias("scale"), entropy.scale_index(F.col("scale"), entropy.scale_table()).alias("bucket"))


def escape_bits(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_quantity").cast("long") - 10
    rows = table(spark, d, "lineitem").select(s.alias("sym"), entropy.escape_bits(s, F.lit(16)).alias("bits"))
    return rows.groupBy("sym", "bits").agg(F.count("*").alias("cells"))


def normal_likelihood(spark: SparkSession, d: str) -> DataFrame:
    p = entropy.interval_likelihood(F.rint(F.col("v") * 8), F.lit(0.0), F.lit(2.0))
    return rounded(field(spark, d).groupBy("n").agg(F.sum(-F.log2(p)).alias("bits")), "bits")


def mixture_likelihood(spark: SparkSession, d: str) -> DataFrame:
    x = F.rint(F.col("v") * 8)
    p = 0.25 * entropy.interval_likelihood(x, F.lit(-1.0), F.lit(1.0)) + 0.75 * entropy.interval_likelihood(x, F.lit(1.0), F.lit(3.0))
    return rounded(field(spark, d).groupBy("n").agg(F.sum(-F.log2(p)).alias("bits")), "bits")


def cdf_lookup(spark: SparkSession, d: str) -> DataFrame:
    cdf = entropy.smoothed_cdf(entropy.histogram(symbols(spark, d), "stream"), "stream")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("stream"), F.col("l_quantity").cast("long").alias("sym"))
    return lines.join(sent_whole(kept(cdf), entropy.MOST_RANGES), ["stream", "sym"]).select("l_orderkey", "l_linenumber", "lo", "hi")


def symbol_range_join(spark: SparkSession, d: str) -> DataFrame:
    cdf = entropy.smoothed_cdf(entropy.histogram(symbols(spark, d), "stream"), "stream")
    asked = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("stream"), F.pmod(F.col("l_orderkey") * 40503 + F.col("l_linenumber") * 977, F.lit(65536)).alias("cf"))
    return entropy.range_lookup(asked, cdf, "stream").select("l_orderkey", "l_linenumber", "cf", "sym")


def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return entropy.prefix_sums(sizes, "source", "doc_id", "size", width=4096).select("source", "doc_id", "size", F.col("before").alias("offset"))


# ------------------------------------------------------------------- lookups
def side_file_join(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def dict_remap(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return search.remapped(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key")), "key", nations, "n_name").select("c_custkey", "n_name")


def missing_results(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return search.missing(wanted, table(spark, d, "orders").select((F.col("o_custkey") + 20).alias("k")), ["k"])


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Each label's slices under eight step sizes: (label, q, rmse, bits)."""
    steps = field(spark, d).withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(8))))
    e = F.col("v") - F.rint(F.col("v") * F.col("q")) / F.col("q")
    return steps.groupBy("label", "q").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(F.log2(1 + F.abs(F.rint(F.col("v") * F.col("q"))))).alias("bits"))


def sweep_cross(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sweep(spark, d), "rmse", "bits", places=5)


def recon_join(spark: SparkSession, d: str) -> DataFrame:
    a = field(spark, d).select("n", "h", "w", "v")
    b = a.select("n", "h", "w", (F.rint(F.col("v") * 50) / 50).alias("r"))
    return rounded(a.join(b, ["n", "h", "w"]).groupBy("n").agg(F.max(F.abs(F.col("v") - F.col("r"))).alias("maxe")), "maxe")


def prev_frame(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    over = W.partitionBy("user_id").orderBy("ts", "event_id")
    frames = e.withColumn("frame", F.row_number().over(over) - 1).withColumn("change", F.round(F.col("value") - F.coalesce(F.lag("value").over(over), F.lit(0.0)), 6))
    return frames.select("user_id", "event_id", F.col("frame").cast("long").alias("frame"), (F.col("frame") == 0).alias("key_frame"), "change")


def full_outer_audit(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, d, "orders").select((F.col("o_custkey") + 20).alias("k"))
    return search.audit(a, b, ["k"])


def support_set(spark: SparkSession, d: str) -> DataFrame:
    """For each slice of a group of ten, the slices before it, the first four at most."""
    rows = table(spark, d, "embeddings").select((F.floor(F.col("vec_id") / 10)).cast("long").alias("g"), F.col("vec_id").alias("n"))
    before = F.collect_list("n").over(W.partitionBy("g").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    return rows.select("g", "n", F.array_join(F.slice(before, 1, 4), ",").alias("support"))


# -------------------------------------------------------------------- points
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return rounded(points.neighbours(c, c, 4), "d2", places=9)


def ball_query(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return points.ball_query(c, c, 0.5, 8)


def chamfer(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return rounded(points.chamfer(c.where("p % 2 = 0"), c.where("p % 2 = 1")), "chamfer")


def mutual_nn_density(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return rounded(points.collapsed_sets(c.where("p % 5 = 0"), c, 8), "distance")


def idw3(spark: SparkSession, d: str) -> DataFrame:
    c = cloud(spark, d)
    return rounded(points.interpolated(c.where("p % 2 = 0"), c.where("p % 2 = 1"), "z"), "value")


def unit_clouds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(points.unit_clouds(cloud(spark, d)), "x", "y", "z")


def farthest_points(spark: SparkSession, d: str) -> DataFrame:
    return points.farthest_points(cloud(spark, d), 8)


# ------------------------------------------------------------- sets, searches
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("k"))
    return a.unionByName(b).groupBy("source", "k").agg(F.count("*").alias("n"))


def distinct_dense_rank(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "part").select("p_brand").distinct()
    ranks = kinds.withColumn("rank", F.dense_rank().over(W.orderBy("p_brand")).cast("long"))  # one row per brand
    return table(spark, d, "part").join(ranks, "p_brand").select("p_partkey", "rank")


def param_disjoint(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a, b = p.where("p_size <= 25").select("p_type"), p.where("p_size > 25").select("p_type")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(a.intersect(b), "shared").unionAll(count(a.union(b).distinct(), "all")).unionAll(count(a.exceptAll(b).distinct(), "more_in_a"))


def find_close(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.closest(sweep(spark, d).withColumn("rmse", F.round("rmse", 9)), "label", "q", "rmse", 0.05), "rmse")


def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return search.top_k(rows, ["o_custkey"], 3, F.desc("o_totalprice"), F.asc("o_orderkey")).withColumn("rank", F.col("rank").cast("long"))


def every_kth_first3(spark: SparkSession, d: str) -> DataFrame:
    return search.every_kth(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 4, 3)


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample by hash is the feature: about a tenth of the orders, the same at each run."""
    return search.hash_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.1)


def resampled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    return search.resampled(rows, "s_nationkey", "s_suppkey", 6).select("s_nationkey", "s_suppkey", F.col("place").cast("long").alias("place"))


# ------------------------------------------------------------ scans and records
def url_facts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    part = lambda pattern: F.regexp_extract(u, pattern, 1)
    return table(spark, d, "pages").select("page_id", part(r"^(\w+)://").alias("scheme"), part(r"^\w+://([^/:]+)").alias("host"), part(r"^\w+://[^/]+/(\w+)").alias("first"), F.try_to_number(F.nullif(part(r"/(\d+)(?:[?#]|$)"), F.lit("")), F.lit("999999999")).cast("long").alias("number"))


def video_names(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    name = F.concat(F.col("p_brand"), F.lit("_"), (size * 16).cast("string"), F.lit("x"), (size * 9).cast("string"), F.lit("_"), (F.lit(24) + size % 3).cast("string"), F.lit("Hz_"), F.when(size % 2 == 0, "8bit").otherwise("10bit"), F.lit("_P420.yuv"))
    rows = table(spark, d, "part").select("p_partkey", F.regexp_replace(name, "#", "").alias("name"))
    info = rows.select("p_partkey", *video.raw_video_info(F.col("name")))
    frames = video.frame_count(F.lit(10_000_000), F.col("width"), F.col("height"), F.col("chroma"), F.col("bits"))
    return info.select("p_partkey", "width", "height", "fps", "bits", "chroma", frames.alias("frames"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy(k.alias("k"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def header_pack_bits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", containers.packed_header(F.col("p_partkey") % 256, F.col("p_partkey") % 3, F.col("p_size") % 8 + 1).alias("header"))
    return rows.select("p_partkey", F.hex("header").alias("header"), *containers.header_fields(F.col("header")))


def packed_bodies(spark: SparkSession, d: str) -> DataFrame:
    body = containers.packed_body(F.col("p_size"), F.col("p_size") * 2, [F.col("p_brand"), F.col("p_type")])
    return table(spark, d, "part").select("p_partkey", F.hex(body).alias("body"))


def list_expand(spark: SparkSession, d: str) -> DataFrame:
    return video.frame_paths(table(spark, d, "part").select(F.col("p_name").alias("clip")).distinct(), 3).select("clip", F.col("frame").cast("long").alias("frame"), "path")


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", containers.content_sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def result_json(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps to records of arrays and back to rows."""
    rows = sweep(spark, d).select(F.concat(F.lit("codec"), F.col("label").cast("string")).alias("name"), F.explode(F.map_from_arrays(F.array(F.lit("psnr"), F.lit("bits")), F.array(-20 * F.log10("rmse"), F.col("bits")))).alias("metric", "value"), (F.col("q") - 1).alias("i"))
    back = containers.result_rows(containers.result_records(rows))
    return rounded(back.select("name", containers.metric_name(F.col("metric")).alias("metric"), F.col("i").cast("long").alias("i"), "value"), "value", places=5)


# -------------------------------------------------------------------- coders
def rans_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Streams coded, decoded and compared: one row per stream."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supp"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("sym"))
    encoded = coder.encode_streams(coder.chunked(lines, "l_orderkey", 1 << 16), "supp", ["l_orderkey", "l_linenumber"])
    return coder.checked_streams(encoded, "supp").groupBy("supp").agg(F.sum("n").alias("n"), F.min("same").alias("same"))


# -------------------------------------------------------------------- events
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.window_totals(windows.timed(table(spark, d, "events")), "event_type", "1 day"), "total", places=4).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def sliding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.window_totals(windows.timed(table(spark, d, "events")), "event_type", "2 days", "1 day"), "total", places=4).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    out = windows.session_totals(windows.timed(table(spark, d, "events")), "user_id", "4 hours")
    return rounded(out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("total").alias("total")), "total", places=4)


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    """A streaming run over the events, to its end: frames of each user that differ from the one before."""
    schema = table(spark, d, "events").schema
    # several types of one name share a folder, so the stream reads the one file by a pattern
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    frames = windows.running_frames(windows.timed(stream), "user_id")
    run = windows.written_stream(frames, new_path(spark, "streams"), new_path(spark, "stream-state"))
    return run.groupBy("user_id").agg(F.count("*").alias("frames"), F.sum(F.col("first").cast("long")).alias("key_frames"), F.round(F.sum("change"), 4).alias("last"))


QUERIES = {f.__name__: f for f in (
    symbol_histogram, symbol_entropy, smoothed_cdf, cdf_prefix, pmf_from_cdf, bit_cost, context_entropy, zero_slices, channel_activity, scale_bucket, escape_bits, normal_likelihood, mixture_likelihood, cdf_lookup, symbol_range_join, chunk_offsets,
    side_file_join, dict_remap, missing_results, sweep_cross, recon_join, prev_frame, full_outer_audit, support_set, knn_join, ball_query, chamfer, mutual_nn_density, idw3, unit_clouds, farthest_points, union_sources, distinct_dense_rank,
    param_disjoint, find_close, topk_per_group, every_kth_first3, hash_sample, resampled, url_facts, video_names, json_props, header_pack_bits, packed_bodies, list_expand, content_hash, result_json, rans_roundtrip, tumbling, sliding, sessions, event_frames,
)}
