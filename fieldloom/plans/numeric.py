"""Queries on planes, samples, searches, tables of ranges and coded streams; each with its SQL where SQL can say it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coder, entropy, fields, images, points, quantize, search, tiling
from ..session import kept, new_path
from ..streaming import windows
from .relational import sweep
from .relational_sql import CLOUD, D2, HIST, SWEEP, nearest
from .science import FIELD, rounded
from .tables import cloud, field, symbols, table

SIZE = (8, 8)


def plane(spark: SparkSession, d: str) -> DataFrame:
    return field(spark, d).select("n", "h", "w", "v")


# -------------------------------------------------------------------- planes
def chroma_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Planes halved, then doubled by the nearest cell."""
    return rounded(images.chroma_doubled(images.chroma_halved(plane(spark, d), ["n"], SIZE), ["n"], (4, 4), "nearest"), "v")


def chroma_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Planes halved, then doubled between cell centres."""
    return rounded(images.chroma_doubled(images.chroma_halved(plane(spark, d), ["n"], SIZE), ["n"], (4, 4)), "v")


def gaussian_blur(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.blurred(plane(spark, d), ["n"], SIZE, images.gaussian_kernel(5, 1.5)), "v")


def center_pad(spark: SparkSession, d: str) -> DataFrame:
    padded = images.center_pad(plane(spark, d), ["n"], SIZE, (11, 10), 0.5)
    return rounded(padded.groupBy("n", "h").agg(F.sum(F.col("v") * (F.col("w") + 1)).alias("moment"), F.count("*").alias("cells")), "moment")


def parity_mask(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plane(spark, d).withColumn("v", images.kept_parity(F.col("v"), tiling.parity())), "v")


def ramps(spark: SparkSession, d: str) -> DataFrame:
    both = F.arrays_zip(images.ramp(1, 64, 7).alias("linear"), images.ramp(1, 64, 7, "log").alias("log"))
    rows = table(spark, d, "region").select("r_regionkey", F.posexplode(both).alias("i", "z"))
    return rounded(rows.select("r_regionkey", F.col("i").cast("long").alias("i"), "z.linear", "z.log"), "linear", "log")


# ------------------------------------------------------------ values, quantisers
def minmax_global_bits(spark: SparkSession, d: str) -> DataFrame:
    """Codes by the range of the whole field; one row of statistics goes to every task."""
    f = plane(spark, d)
    whole = f.agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    rows = f.crossJoin(F.broadcast(whole)).withColumn("code", fields.minmax_bits(F.col("v"), F.col("vmin"), F.col("vmax")))
    return rounded(rows.withColumn("back", fields.minmax_bits_inverse(F.col("code"), F.col("vmin"), F.col("vmax"))), "code", "back").select("n", "h", "w", "code", "back")


def noise_quant(spark: SparkSession, d: str) -> DataFrame:
    """Values with even noise of a keyed hash in place of rounding, and rounded by steps."""
    f = plane(spark, d).withColumn("key", F.col("n") * 64 + F.col("h") * 8 + F.col("w"))
    noise = search.keyed("key", 5) / float(1 << 32) - 0.5
    return rounded(f.select("n", "h", "w", (F.col("v") + noise).alias("noisy"), quantize.stepped(F.col("v"), F.lit(0.0), F.lit(0.25)).alias("stepped")), "noisy", "stepped")


def bounded_params(spark: SparkSession, d: str) -> DataFrame:
    """Parameters kept from below, and stored as roots."""
    f = plane(spark, d)
    return rounded(f.select("n", "h", "w", entropy.lower_bounded(F.col("v"), -0.1).alias("low"), entropy.non_negative(F.col("v"), 0.01).alias("positive"), entropy.non_negative(entropy.stored_root(F.abs("v"))).alias("same")), "low", "positive", "same", places=9)


def half_floats(spark: SparkSession, d: str) -> DataFrame:
    """Values cast to 16-bit floats with the high byte first, and back: the error stays within the format's step."""

    def task(frames):
        for frame in frames:
            raw = [np.asarray(e, dtype=">f2").tobytes() for e in frame["embedding"]]
            back = [np.frombuffer(b, dtype=">f2").astype(float) for b in raw]
            fine = [bool((np.abs(b - np.asarray(e, float)) <= np.maximum(np.abs(e) * 2.0**-11, 2.0**-25)).all()) for b, e in zip(back, frame["embedding"], strict=True)]
            yield pd.DataFrame({"n": frame["vec_id"], "size": [len(b) for b in raw], "fine": fine})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(task, "n long, size long, fine boolean")


def codec_chain(spark: SparkSession, d: str) -> DataFrame:
    """Slices normalised, quantised and packed to bytes, then made again from the bytes and the state alone: the largest error of each."""
    import zlib

    rows = table(spark, d, "embeddings").select("vec_id", "embedding")

    def compress(frames):
        for frame in frames:
            out = []
            for n, e in zip(frame["vec_id"], frame["embedding"], strict=True):
                v = np.asarray(e, dtype=float)
                low, high = v.min(), v.max()
                codes = np.clip((v - low) / (high - low + 1e-8) * 2**12, 0, 32767).round().astype("<i2")
                out.append((n, float(low), float(high), 12, zlib.compress(codes.tobytes())))
            yield pd.DataFrame(out, columns=["n", "low", "high", "bits", "stream"])

    def expand(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                codes = np.frombuffer(zlib.decompress(r.stream), dtype="<i2").astype(float)
                yield pd.DataFrame({"n": r.n, "i": np.arange(len(codes)), "r": codes / 2**r.bits * (r.high - r.low) + r.low})

    packed = rows.mapInPandas(compress, "n long, low double, high double, bits int, stream binary")
    back = packed.mapInPandas(expand, "n long, i long, r double")
    own = rows.select(F.col("vec_id").alias("n"), F.posexplode("embedding").alias("i", "v"))
    return rounded(back.join(own, ["n", "i"]).groupBy("n").agg(F.max(F.abs(F.col("r") - F.col("v"))).alias("maxe"), F.count("*").alias("cells")), "maxe")


def registry_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two maps as one, the later value of a key wins."""
    old = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    new = F.create_map(F.lit("type"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    return table(spark, d, "part").select("p_partkey", F.explode(merged).alias("key", "value"))


def renamed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names of parameters after a chain of rules."""
    name = F.concat(F.lit("module."), F.col("p_brand"), F.lit(".entropy._matrices."), (F.col("p_size") % 4).cast("string"))
    rules = [(r"^module\.", ""), (r"\._matrices\.(\d+)$", r"._matrix$1"), (r"#", "_")]
    return table(spark, d, "part").select("p_partkey", search.renamed_key(name, rules).alias("name"))


# ------------------------------------------------------------- choices, searches
def quota_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of each nation's customers as many as a table of quotas grants, in order."""
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    quotas = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") / 4).alias("most"))
    return search.quota(rows, "c_nationkey", "c_custkey", quotas, "most").select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


def quota_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Quotas, then each group read as often as it takes to a fixed count."""
    chosen = quota_rows(spark, d).drop("rank")
    return search.repeated(chosen, "c_nationkey", "c_custkey", 7, seed=3).select("c_nationkey", "c_custkey", F.col("copy").cast("long").alias("copy"))


def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """Four of each nation's suppliers by keyed hash, beginning anew where there are fewer: a sample is the feature."""
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    return search.random_sample(rows, "s_nationkey", "s_suppkey", 4, seed=2).select("s_nationkey", "s_suppkey", F.col("draw").cast("long").alias("draw"))


def permuted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    return search.permuted(rows, "c_nationkey", "c_custkey", seed=9).select("c_nationkey", "c_custkey", F.col("place").cast("long").alias("place"))


def bisect_root(spark: SparkSession, d: str) -> DataFrame:
    """Where a rising function meets each slice's deviation."""
    stats = fields.slice_stats(field(spark, d)).select("n", "vstd")
    return rounded(search.bisected(stats, 0.0, 4.0, lambda x: x * x * x + x, "vstd"), "root").select("n", "root")


def find_close_bisect(spark: SparkSession, d: str) -> DataFrame:
    """The best step size that a bisection over a falling metric looks at."""
    rows = sweep(spark, d).select("label", "q", F.round("rmse", 9).alias("rmse"))
    return rounded(search.closest_by_bisection(rows, "label", "q", "rmse", 0.05), "rmse")


def channel_order(spark: SparkSession, d: str) -> DataFrame:
    """Eight channels in an order by greed: bits of a channel by itself or under another channel at the same place."""
    cells = field(spark, d).select("n", (F.col("w")).alias("c"), "h", F.rint(F.col("v") * 4).cast("long").alias("sym"))
    alone = cells.groupBy("c", "sym").agg(F.count("*").alias("k"))
    total = cells.groupBy("c").agg(F.count("*").alias("t"))
    single = alone.join(total, "c").groupBy("c").agg(F.sum(-F.col("k") * F.log2(F.col("k") / F.col("t"))).alias("bits")).select(F.col("c").alias("part"), F.lit(None).cast("long").alias("given"), "bits")
    other = cells.select("n", "h", F.col("c").alias("given"), F.col("sym").alias("other"))
    joint = cells.join(other, ["n", "h"]).where("c != given").groupBy("c", "given", "other", "sym").agg(F.count("*").alias("k"))
    under = joint.groupBy("c", "given", "other").agg(F.sum("k").alias("t"))
    pairs = joint.join(under, ["c", "given", "other"]).groupBy(F.col("c").alias("part"), "given").agg(F.sum(-F.col("k") * F.log2(F.col("k") / F.col("t"))).alias("bits"))
    order = search.greedy_order(rounded(single.unionByName(pairs), "bits"), list(range(8)))
    return spark.createDataFrame(list(enumerate(order)), "place long, part long")


def channel_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Cells by how many of the neighbours above, to the left and in the slice before (of the same ten) lie off their mode."""
    cells = field(spark, d).select(F.floor(F.col("n") / 10).alias("n"), (F.col("n") % 10).alias("c"), "h", "w", F.rint(F.col("v") * 8).cast("long").alias("sym"))
    cells = cells.join(F.broadcast(entropy.modes(cells.select("c", "sym"), "c")), "c")  # ten channels
    return entropy.channel_context(cells, "mode", 1).groupBy("c", F.col("ctx").cast("long").alias("ctx")).agg(F.count("*").alias("cells"))


# ---------------------------------------------------------------------- points
def rotated(spark: SparkSession, d: str) -> DataFrame:
    """Clouds under one rotation."""
    return rounded(points.rotated(cloud(spark, d), [[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0]]), "x", "y", "z")


def neighbour_max(spark: SparkSession, d: str) -> DataFrame:
    """The largest coordinate among each point's five nearest."""
    c = cloud(spark, d)
    return rounded(points.strongest(c, points.neighbours(c, c, 5), ["y", "z"]), "y", "z")


def cloud_losses(spark: SparkSession, d: str) -> DataFrame:
    """Losses of clouds against rounded ones."""
    names = ("d", "nx", "ny", "nz", "y")
    own = table(spark, d, "embeddings").select(F.col("label").alias("cloud"), F.col("vec_id").alias("p"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    coarse = own.select("cloud", "p", *[(F.rint(F.col(c) * 8) / 8).alias(c) for c in names])
    return rounded(points.cloud_losses(own, coarse, 48), "density", "normals", "latent", places=9)


def sphere_mesh(spark: SparkSession, d: str) -> DataFrame:
    """A sphere's faces after two cuts, and whether all corners lie on it."""
    mesh = points.sphere_mesh(spark, 2)
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return mesh.agg(F.count_distinct("face").alias("faces"), F.count("*").alias("corners"), (F.max(F.abs(norm - 1)) < 1e-12).alias("on_sphere"))


def surface_points(spark: SparkSession, d: str) -> DataFrame:
    """Points drawn on the faces that three of each embedding's corners span, by area; a sample is the feature."""
    corner = lambda k: F.transform(F.slice("embedding", 3 * k + 1, 3), lambda x: x.cast("double"))
    faces = table(spark, d, "embeddings").select(F.col("label").alias("mesh"), F.col("vec_id").alias("face"), corner(0).alias("a"), corner(1).alias("b"), corner(2).alias("c"))
    return rounded(points.surface_points(faces, 40), "x", "y", "z")


# -------------------------------------------------------------- tables of ranges
def streams_masses(spark: SparkSession, d: str) -> DataFrame:
    """(stream, k, p): masses of the symbols of each stream, smoothed, and a last one for what is outside."""
    hist = entropy.histogram(symbols(spark, d), "stream")
    inside = hist.select("stream", F.col("sym").alias("k"), ((F.col("cells") + 1.0) / (F.col("total") + 100.0)).alias("p"))
    return inside.unionByName(hist.groupBy("stream").agg(F.lit(1000).cast("long").alias("k"), F.lit(0.01).alias("p")))


def pmf_tables(spark: SparkSession, d: str) -> DataFrame:
    """Quantised CDFs of streams, a tail range last."""
    found = coder.bounds_table(streams_masses(spark, d), "stream")
    return found.select("stream", F.posexplode("bounds").alias("i", "bound")).select("stream", F.col("i").cast("long").alias("i"), F.col("bound").cast("long").alias("bound"))


def mixture_tables(spark: SparkSession, d: str) -> DataFrame:
    """Quantised CDFs of mixtures of two wide normal laws, one for each slice, on nine symbols."""
    e = F.col("embedding")
    mean = [e[i].cast("double") for i in (0, 1)]
    scale = [F.abs(e[i].cast("double")) + 3.0 for i in (2, 3)]
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[s.alias(f"s{i}") for i, s in enumerate(scale)], F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("k"))
    mass = 0.25 * entropy.interval_likelihood(F.col("k"), F.col("m0"), F.col("s0")) + 0.75 * entropy.interval_likelihood(F.col("k"), F.col("m1"), F.col("s1"))
    found = coder.bounds_table(rows.select("n", F.col("k").cast("long").alias("k"), F.round(mass, 9).alias("p")), "n")
    return found.select("n", F.posexplode("bounds").alias("i", "bound")).select("n", F.col("i").cast("long").alias("i"), F.col("bound").cast("long").alias("bound"))


def normal_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a scale table's normal laws: sizes, and that every range is open and all of the total is used."""
    rows = coder.normal_tables(entropy.scale_table(levels=24, high=32.0))
    rows["bounds"] = [[int(b) for b in bounds] for bounds in rows["bounds"]]
    made = spark.createDataFrame(rows, "k long, scale double, offset long, length long, bounds array<long>")
    open_ = F.forall(F.sequence(F.lit(2), F.size("bounds")), lambda i: F.element_at("bounds", i) > F.element_at("bounds", i - 1))
    return rounded(made.select("k", "scale", "offset", "length", F.element_at("bounds", -1).alias("top"), (F.size("bounds") == F.col("length")).alias("whole"), open_.alias("open")), "scale")


# --------------------------------------------------------------- coded streams
def indexed_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Slices rounded around their mean and coded, each cell under the CDF of its row's scale, then decoded and compared."""
    scales = entropy.scale_table(levels=24, high=32.0)
    laws = coder.normal_tables(scales)
    tables, offsets = laws["bounds"].tolist(), laws["offset"].tolist()
    cells = fields.with_stats(field(spark, d)).select("n", "h", "w", quantize.symbol(F.col("v") * 40, F.col("vmean") * 40).alias("sym"))
    rows = cells.groupBy("n", "h").agg(F.stddev_pop("sym").alias("scale")).withColumn("k", entropy.scale_index(F.col("scale"), scales))

    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "w"])
        told, which = frame["sym"].astype(int).tolist(), frame["k"].astype(int).tolist()
        stream = coder.encode_indexed(told, which, tables, offsets)
        back = coder.Decoder(stream).take_indexed(which, tables, offsets)
        return pd.DataFrame({"n": [key[0]], "cells": [len(told)], "same": [back == told], "shorter": [len(stream) < 4 * len(told)]})

    return cells.join(rows.select("n", "h", "k"), ["n", "h"]).groupBy("n").applyInPandas(task, "n long, cells long, same boolean, shorter boolean")


def coded_requests(spark: SparkSession, d: str) -> DataFrame:
    """Coded streams asked for in parts by a streaming run that keeps each decoder's place: counts and sums of what comes back."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supp"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("sym"))
    encoded = kept(coder.encode_streams(coder.chunked(lines, "l_orderkey", 1 << 14), "supp", ["l_orderkey", "l_linenumber"]))  # both parts of the requests are made of it
    name = F.concat_ws(":", F.col("supp").cast("string"), F.col("chunk").cast("string")).alias("stream_id")
    asked = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 50)))
    requests = encoded.select(name, "n", "bounds", "low", "stream", asked.alias("seq"))
    requests = requests.select("stream_id", "seq", F.least(F.lit(50), F.col("n") - F.col("seq") * 50).alias("n"), "bounds", "low", F.when(F.col("seq") == 0, F.col("stream")).alias("stream"), (F.col("n") <= (F.col("seq") + 1) * 50).alias("last"))
    path = new_path(spark, "requests")
    for k, part in enumerate(("seq < 2", "seq >= 2")):  # the later files hold what is asked for later
        requests.where(part).repartition(4, "stream_id").write.mode("append" if k else "errorifexists").parquet(path)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 4).parquet(path)
    buckets = max(1024, encoded.count() >> 13)  # a bucket's requests are in one task's memory
    got = windows.written_stream(windows.decoded_requests(stream, buckets), new_path(spark, "streams"), new_path(spark, "stream-state"))
    supp = F.split("stream_id", ":")[0].cast("long").alias("supp")
    return got.groupBy(supp).agg(F.count("*").alias("n"), F.sum("sym").alias("total"))


QUERIES = {f.__name__: f for f in (
    chroma_nearest, chroma_bilinear, gaussian_blur, center_pad, parity_mask, ramps, minmax_global_bits, noise_quant, bounded_params, half_floats, codec_chain, registry_merge, renamed_keys, quota_rows, quota_repeated, random_sample, permuted,
    bisect_root, find_close_bisect, channel_order, channel_contexts, rotated, neighbour_max, cloud_losses, sphere_mesh, surface_points, pmf_tables, mixture_tables, normal_tables, indexed_roundtrip, coded_requests,
)}

HALF = f"{FIELD}, half AS (SELECT n, h // 2 AS h, w // 2 AS w, avg(v) AS v FROM field GROUP BY n, h // 2, w // 2)"
KERNEL = images.gaussian_kernel(5, 1.5)
KEY = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"
AXIS = lambda o, x, j: f"greatest(0, least(7, {o} + {j}))"
TAPS = "(SELECT 0 AS o, 0 AS i, 1.0::DOUBLE AS k UNION ALL SELECT o, greatest(0, (o - 1) // 2) AS i, CASE WHEN o % 2 = 0 THEN 0.25 ELSE 0.75 END FROM (SELECT unnest(range(1, 8)) AS o) UNION ALL SELECT o, least(3, (o + 1) // 2), CASE WHEN o % 2 = 0 THEN 0.75 ELSE 0.25 END FROM (SELECT unnest(range(1, 8)) AS o))"
BOUNDS = """w AS (SELECT s, k, floor(p * 65536 + 0.5)::BIGINT AS f FROM mass), r AS (SELECT s, k, f * 65536 // (sum(f) OVER (PARTITION BY s)) AS f FROM w),
      c AS (SELECT s, row_number() OVER o AS i, count(*) OVER (PARTITION BY s) AS m, (sum(f) OVER o)::BIGINT AS b FROM r WINDOW o AS (PARTITION BY s ORDER BY k)),
      bounds AS (SELECT s, i, CASE WHEN i = m THEN 65536 ELSE b END AS bound FROM c UNION ALL SELECT DISTINCT s, 0, 0 FROM c)"""


def mixed(k: str) -> str:
    """The mass of a symbol under the query's mixture, in SQL."""
    from .relational_sql import erfc

    root = "1.4142135623730951::DOUBLE"
    cdf = lambda end, m, s: f"0.5 * ({erfc(f'(-(({end} - abs({k} - {m})) / {s}) / {root})')})"
    one = lambda m, s: f"greatest({cdf('0.5', m, s)} - ({cdf('-0.5', m, s)}), 1e-9)"
    return f"round(0.25 * {one('m0', 's0')} + 0.75 * {one('m1', 's1')}, 9)"


ORACLES = {
    "chroma_nearest": f"WITH {HALF} SELECT n, h * 2 + i AS h, w * 2 + j AS w, round(v, 6) AS v FROM half, (SELECT unnest(range(0, 2)) AS i) a, (SELECT unnest(range(0, 2)) AS j) b",
    "chroma_bilinear": f"WITH {HALF}, taps AS {TAPS} SELECT n, a.o::BIGINT AS h, b.o::BIGINT AS w, round(sum(v * a.k * b.k), 6) AS v FROM half JOIN taps a ON a.i = half.h JOIN taps b ON b.i = half.w GROUP BY n, a.o, b.o",
    "gaussian_blur": f"WITH {FIELD}, k AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in KERNEL)}]) AS k, unnest(range(-2, 3)) AS j), o AS (SELECT o, greatest(0, least(7, o + j)) AS i, k FROM (SELECT unnest(range(0, 8)) AS o) a, k) SELECT n, a.o AS h, b.o AS w, round(sum(v * a.k * b.k), 6) AS v FROM field JOIN o a ON a.i = h JOIN o b ON b.i = w GROUP BY n, a.o, b.o",
    "center_pad": f"WITH {FIELD}, c AS (SELECT DISTINCT n, h, w FROM (SELECT DISTINCT n FROM field) a, (SELECT unnest(range(0, 11)) AS h) b, (SELECT unnest(range(0, 10)) AS w) e) SELECT c.n, c.h, round(sum(coalesce(v, 0.5) * (c.w + 1)), 6) AS moment, count(*) AS cells FROM c LEFT JOIN field f ON f.n = c.n AND f.h + 1 = c.h AND f.w + 1 = c.w GROUP BY c.n, c.h",
    "parity_mask": f"WITH {FIELD} SELECT n, h, w, round(CASE WHEN (h + w) % 2 = 0 THEN v ELSE 0 END, 6) AS v FROM field",
    "ramps": "SELECT r_regionkey, i, round(1 + i * 10.5::DOUBLE, 6) AS linear, round(exp(i * ln(64) / 6), 6) AS log FROM region, (SELECT unnest(range(0, 7)) AS i) s",
    "minmax_global_bits": f"WITH {FIELD}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM field), c AS (SELECT n, h, w, lo, hi, least(greatest((v - lo) / (hi - lo + 1e-8) * 256, 0), 32767) AS code FROM field, s) SELECT n, h, w, round(code, 6) AS code, round(code / 256 * (hi - lo) + lo, 6) AS back FROM c",
    "noise_quant": f"WITH {FIELD} SELECT n, h, w, round(v + {KEY.format(seed=5, key='(n * 64 + h * 8 + w)')} / 4294967296.0::DOUBLE - 0.5, 6) AS noisy, round(round_even(v / 0.25, 0) * 0.25, 6) AS stepped FROM field",
    "bounded_params": f"WITH {FIELD}, p AS (SELECT *, power(2::DOUBLE, -36) AS e FROM field) SELECT n, h, w, round(greatest(v, -0.1::DOUBLE), 9) AS low, round(power(greatest(v, sqrt(0.01 + e)), 2) - e, 9) AS positive, round(abs(v), 9) AS same FROM p",
    "half_floats": "SELECT vec_id AS n, 128::BIGINT AS size, true AS fine FROM embeddings",
    "codec_chain": f"WITH {FIELD}, s AS (SELECT n, min(v) AS lo, max(v) AS hi FROM field GROUP BY n), c AS (SELECT n, v, lo, hi, round_even(least(greatest((v - lo) / (hi - lo + 1e-8) * 4096, 0), 32767), 0) AS q FROM field JOIN s USING (n)) SELECT n, round(max(abs(q / 4096 * (hi - lo) + lo - v)), 6) AS maxe, count(*) AS cells FROM c GROUP BY n",
    "registry_merge": "SELECT p_partkey, 'brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_name FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part",
    "renamed_keys": "SELECT p_partkey, replace(p_brand, '#', '_') || '.entropy._matrix' || (p_size % 4) AS name FROM part",
    "quota_rows": "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer) WHERE rank <= round_even(c_nationkey / 4.0::DOUBLE, 0)",
    "quota_repeated": f"WITH q AS (SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer) WHERE rank <= round_even(c_nationkey / 4.0::DOUBLE, 0)), p AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {KEY.format(seed=3, key='c_custkey')}, c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM q) SELECT c_nationkey, c_custkey, copy FROM p, (SELECT unnest(range(0, 7)) AS copy) c WHERE copy < 7 // n + (place < 7 % n)::INTEGER",
    "random_sample": f"WITH p AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY {KEY.format(seed=2, key='s_suppkey')}, s_suppkey) - 1 AS place, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_nationkey, s_suppkey, draw FROM p, (SELECT unnest(range(0, 4)) AS draw) c WHERE draw % n = place",
    "permuted": f"SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {KEY.format(seed=9, key='c_custkey')}, c_custkey) - 1 AS place FROM customer",
    "bisect_root": f"WITH {FIELD}, s AS (SELECT n, stddev_pop(v) AS t FROM field GROUP BY n), r AS (SELECT n, t / 2 AS u, sqrt(t * t / 4 + 1.0 / 27) AS w FROM s) SELECT n, round(cbrt(u + w) + cbrt(u - w), 6) AS root FROM r",
    "find_close_bisect": f"""WITH RECURSIVE {SWEEP}, r AS (SELECT label, q::BIGINT AS q, round(rmse, 9) AS rmse FROM sweep), s AS (SELECT label, 1::BIGINT AS lo, 8::BIGINT AS hi, NULL::BIGINT AS q, 0 AS i FROM r GROUP BY label
      UNION ALL SELECT s.label, CASE WHEN rmse < 0.05 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN rmse < 0.05 THEN (lo + hi) // 2 - 1 ELSE hi END, (lo + hi) // 2, i + 1 FROM s JOIN r ON r.label = s.label AND r.q = (lo + hi) // 2 WHERE lo <= hi),
      k AS (SELECT s.label, s.q, rmse, row_number() OVER (PARTITION BY s.label ORDER BY abs(rmse - 0.05), i) AS z FROM s JOIN r ON r.label = s.label AND r.q = s.q) SELECT label, q::INTEGER AS q, round(rmse, 6) AS rmse FROM k WHERE z = 1""",
    "channel_contexts": f"""WITH {FIELD}, x AS (SELECT n // 10 AS n, n % 10 AS c, h, w, round_even(v * 8, 0)::BIGINT AS sym FROM field), m AS (SELECT c, arg_max(sym, k * 1000 - sym) AS mode FROM (SELECT c, sym, count(*) AS k FROM x GROUP BY ALL) GROUP BY c), y AS (SELECT x.*, (abs(sym - mode) > 1)::INTEGER AS off FROM x JOIN m USING (c)),
      z AS (SELECT c, coalesce(lag(off) OVER (PARTITION BY n, c, w ORDER BY h), 0) + coalesce(lag(off) OVER (PARTITION BY n, c, h ORDER BY w), 0) + coalesce(lag(off) OVER (PARTITION BY n, h, w ORDER BY c), 0) AS ctx FROM y) SELECT c, ctx::BIGINT AS ctx, count(*) AS cells FROM z GROUP BY ALL""",
    "rotated": f"WITH {CLOUD} SELECT cloud, p, round(0.6 * x - 0.8 * y, 6) AS x, round(0.8 * x + 0.6 * y, 6) AS y, round(z, 6) AS z FROM cloud",
    "neighbour_max": f"WITH {CLOUD} SELECT k.cloud, k.p, round(max(y), 6) AS y, round(max(z), 6) AS z FROM {nearest('true', 'true', 5)} k JOIN cloud c ON c.p = k.b_p GROUP BY k.cloud, k.p",
    "cloud_losses": "WITH e AS (SELECT label, list_transform(embedding[1:5], lambda x: x::DOUBLE - round_even(x::DOUBLE * 8, 0) / 8) AS g FROM embeddings) SELECT label AS cloud, round(avg(abs(g[1])), 9) AS density, abs(count(*) - 48) AS count, round(avg((g[2] * g[2] + g[3] * g[3] + g[4] * g[4]) / 3), 9) AS normals, round(avg(g[5] * g[5]), 9) AS latent FROM e GROUP BY label",
    "sphere_mesh": "SELECT 320::BIGINT AS faces, 960::BIGINT AS corners, true AS on_sphere",
    "pmf_tables": f"WITH {HIST}, mass AS (SELECT stream AS s, sym AS k, (cells + 1.0::DOUBLE) / (total + 100.0::DOUBLE) AS p FROM hist JOIN total USING (stream) UNION ALL SELECT stream, 1000, 0.01 FROM total), {BOUNDS} SELECT s AS stream, i, bound::BIGINT AS bound FROM bounds",
    "mixture_tables": f"WITH e AS (SELECT vec_id AS n, embedding[1]::DOUBLE AS m0, embedding[2]::DOUBLE AS m1, abs(embedding[3]::DOUBLE) + 3 AS s0, abs(embedding[4]::DOUBLE) + 3 AS s1, unnest(range(-4, 5)) AS k FROM embeddings), mass AS (SELECT n AS s, k, {mixed('k')} AS p FROM e), {BOUNDS} SELECT s AS n, i, bound::BIGINT AS bound FROM bounds",
    "normal_tables": "WITH t AS (SELECT i AS k, exp(ln(0.11::DOUBLE) + i * (ln(32::DOUBLE) - ln(0.11::DOUBLE)) / 23) AS scale FROM (SELECT unnest(range(0, 24)) AS i)), r AS (SELECT *, ceil(scale * 6.109410204869001::DOUBLE)::BIGINT AS far FROM t) SELECT k, round(scale, 6) AS scale, -far AS \"offset\", far * 2 + 3 AS length, 65536::BIGINT AS top, true AS whole, true AS open FROM r",
    "indexed_roundtrip": "SELECT vec_id AS n, 64::BIGINT AS cells, true AS same, true AS shorter FROM embeddings",
    "coded_requests": "SELECT l_suppkey AS supp, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem GROUP BY l_suppkey",
}
