"""Queries on fields: statistics, normalisation, quantisers, metrics, tiles; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import fields, metrics, quantize, tiling
from .tables import field, reconstructed, table

FIELD = """field AS (SELECT vec_id AS n, label, (i - 1) // 8 AS h, (i - 1) % 8 AS w, embedding[i]::DOUBLE AS v
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""
STATS = f"""{FIELD}, stats AS (SELECT n, min(v) AS vmin, max(v) AS vmax, avg(v) AS vmean, stddev_pop(v) AS vstd, count(v) AS cells FROM field GROUP BY n)"""
NORM = f"""{STATS}, norm AS (SELECT f.*, s.vmin, s.vmax, s.vmean, s.vstd, (f.v - s.vmin) / greatest(s.vmax - s.vmin, 1e-12) AS x FROM field f JOIN stats s USING (n))"""
RECON = f"""{NORM}, recon AS (SELECT *, round_even(x * 255, 0) / 255 * (vmax - vmin) + vmin AS r FROM norm)"""


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


def slice_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fields.slice_stats(field(spark, d)), "vmin", "vmax", "vmean", "vstd")


def norm_minmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fields.normalize(field(spark, d)), "x").select("n", "h", "w", "x")


def norm_meanstd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fields.normalize(field(spark, d), "meanstd"), "x").select("n", "h", "w", "x")


def denorm_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = fields.normalize(field(spark, d)).withColumn("e", F.abs(fields.denormalized(F.col("x")) - F.col("v")))
    return back.groupBy("n").agg((F.max("e") < 1e-12).alias("exact"), F.count("*").alias("cells"))


def minmax_scaled_bits(spark: SparkSession, d: str) -> DataFrame:
    rows = field(spark, d).join(fields.slice_stats(field(spark, d)), "n")
    code = fields.minmax_bits(F.col("v"), F.col("vmin"), F.col("vmax"))
    back = fields.minmax_bits_inverse(F.col("code"), F.col("vmin"), F.col("vmax"))
    return rounded(rows.withColumn("code", code).withColumn("back", back), "code", "back").select("n", "h", "w", "code", "back")


def log_quant(spark: SparkSession, d: str) -> DataFrame:
    f = field(spark, d)
    rows = f.join(f.groupBy("n").agg(F.max(F.log1p(F.abs("v"))).alias("most")), "n").withColumn("code", fields.log_code(F.col("v"), F.col("most")))
    return rounded(rows.withColumn("back", fields.log_code_inverse(F.col("code"), F.col("most"))), "code", "back").select("n", "h", "w", "code", "back")


def uniform_quant(spark: SparkSession, d: str) -> DataFrame:
    rows = fields.with_stats(field(spark, d)).withColumn("code", fields.uniform_code(F.col("v"), F.col("vmean"), F.col("vstd")))
    return rounded(rows.withColumn("back", fields.uniform_code_inverse(F.col("code"), F.col("vmean"), F.col("vstd"))), "code", "back").select("n", "h", "w", "code", "back")


def eb_quant(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = field(spark, d).withColumn("code", quantize.eb_code(F.col("v"), 0.05, mode))
        return rows.withColumn("err", F.round(F.abs(quantize.eb_value(F.col("code"), 0.05) - F.col("v")), 6)).select("n", "h", "w", "code", "err")

    return query


def symbols_dequant(spark: SparkSession, d: str) -> DataFrame:
    rows = fields.with_stats(field(spark, d)).withColumn("s", quantize.symbol(F.col("v") * 16, F.col("vmean")))
    return rounded(rows.withColumn("back", quantize.symbol_value(F.col("s"), F.col("vmean"))), "back").select("n", "h", "w", "s", "back")


def variable_step(spark: SparkSession, d: str) -> DataFrame:
    step = 0.01 * (1 + F.col("n") % 4)
    rows = fields.with_stats(field(spark, d)).withColumn("q", quantize.stepped(F.col("v"), F.col("vmean"), step))
    return rounded(rows, "q").select("n", "h", "w", "q")


def truncate16(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quantize.truncated(F.col("l_extendedprice")).alias("q"))
    return rows


def error_bounded_residual(spark: SparkSession, d: str) -> DataFrame:
    rows = fields.with_stats(field(spark, d)).withColumn("q", quantize.residual_code(F.col("v"), F.col("vmean"), 0.01))
    rows = rows.withColumn("err", F.abs(quantize.residual_value(F.col("vmean"), F.col("q"), 0.01) - F.col("v")))
    per = rows.groupBy("n").agg(F.min("q").alias("qmin"), F.max("q").alias("qmax"), (F.max("err") <= 0.01 + 1e-9).alias("bounded"))
    return per.withColumn("bits", quantize.width_of(F.col("qmin"), F.col("qmax")))


def science_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.science_metrics(reconstructed(spark, d)), "rmse", "nrmse", "maxe", "psnr")


def psnr_8bit(spark: SparkSession, d: str) -> DataFrame:
    pairs = fields.normalize(field(spark, d)).select("n", F.col("x").alias("v"), (F.rint(F.col("x") * 31) / 31).alias("r"))
    return rounded(metrics.psnr_8bit(pairs), "mse", "psnr")


def sequence_psnr(spark: SparkSession, d: str) -> DataFrame:
    e = metrics.slice_errors(reconstructed(spark, d))
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("label").alias("seq"))
    return rounded(metrics.sequence_psnr(e.join(labels, "n").select("seq", F.col("n").alias("frame"), "mse")), "mean_of_psnr", "psnr_of_mean")


def yuv_weighted(spark: SparkSession, d: str) -> DataFrame:
    e = metrics.slice_errors(reconstructed(spark, d)).withColumn("psnr", metrics.db(1 / F.nullif(F.col("mse"), F.lit(0.0))))
    plane = F.get(F.array(F.lit("y"), F.lit("u"), F.lit("v")), (F.col("n") % 3).cast("int"))
    planes = e.select(F.floor(F.col("n") / 30).cast("long").alias("seq"), F.floor(F.col("n") % 30 / 3).cast("long").alias("frame"), plane.alias("plane"), "psnr")
    return rounded(metrics.yuv_psnr(planes), "psnr_y", "psnr_u", "psnr_v", "psnr_yuv")


def residual_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.residual_stats(reconstructed(spark, d), "label"), "dmin", "dmax", "dmean", "dstd", "dabs", "dabsmax", "dmedian", "dmse", places=9)


def residual_hist(spark: SparkSession, d: str) -> DataFrame:
    return metrics.residual_histogram(reconstructed(spark, d), -0.01, 0.01, 100)


def rate_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = F.exp(-F.abs(F.col("v"))).alias("p")
    streams = field(spark, d).select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("name"), p)
    return rounded(metrics.rate_rollup(streams, F.lit(1000.0)), "bits", "bpp")


def rd_loss(spark: SparkSession, d: str) -> DataFrame:
    e = metrics.slice_errors(reconstructed(spark, d))
    bpp = F.log2(1 + F.col("span") / 0.01)
    return rounded(e.select("n", metrics.rd_loss(F.col("mse"), bpp, 0.01).alias("loss")), "loss")


def ratio_and_speed(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.sum("l_extendedprice").alias("size"), F.sum("l_quantity").alias("packed"), F.avg("l_tax").alias("seconds"))
    out = parts.select("l_shipdate", metrics.bits_per_cell(F.col("packed"), F.col("size")).alias("bpp"), metrics.gib_per_second(F.col("size") * 1e6, F.col("seconds")).alias("gib_s"), metrics.kbps(F.col("packed"), F.col("size"), F.lit(30.0)).alias("kbps"))
    return rounded(out.withColumn("serial", metrics.serial_rate(F.col("bpp"), F.col("kbps"))), "bpp", "gib_s", "kbps", "serial")


def running_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "lineitem").groupBy("l_suppkey").agg(metrics.weighted_mean("l_discount", "l_quantity").alias("mean")), "mean")


def group_by_3(spark: SparkSession, d: str) -> DataFrame:
    f = field(spark, d)
    n = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return tiling.group_by_three(f, 8, 8, n).groupBy("g", "c").agg(F.count("*").alias("cells"), F.round(F.sum("v"), 6).alias("total"))


SIZE, BLOCK, STRIDE = (8, 8), (4, 4), (3, 3)


def tile_overlap(spark: SparkSession, d: str) -> DataFrame:
    tiles = tiling.overlapped_tiles(field(spark, d), SIZE, BLOCK, STRIDE)
    return tiles.groupBy("n", "th", "tw").agg(F.count("*").alias("cells"), F.round(F.sum("v"), 6).alias("total"), F.max("dh").cast("long").alias("dh"), F.max("dw").cast("long").alias("dw"))


def ola_weighted(spark: SparkSession, d: str) -> DataFrame:
    tiles = tiling.overlapped_tiles(field(spark, d), SIZE, BLOCK, STRIDE).withColumn("v", F.col("v") + 0.001 * (F.col("th") - F.col("tw")))
    return rounded(tiling.overlap_add(tiles, ["n"], BLOCK), "v")


def ola_overwrite(spark: SparkSession, d: str) -> DataFrame:
    tiles = tiling.overlapped_tiles(field(spark, d), SIZE, BLOCK, STRIDE).withColumn("v", F.col("v") + 0.001 * (F.col("th") * 3 + F.col("tw")))
    return rounded(tiling.overwrite(tiles, ["n"]), "v")


def cut_pad(spark: SparkSession, d: str) -> DataFrame:
    cut = tiling.cut_and_pad(field(spark, d), SIZE, (5, 5), 0.6)
    return cut.groupBy("n", "th", "tw").agg(F.count("*").alias("cells"), F.min("dh").cast("long").alias("top"), F.max("dw").cast("long").alias("right"), F.round(F.sum("v"), 6).alias("total"))


def center_crop(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiling.center_crop(field(spark, d), SIZE, (5, 4)), "v").select("n", "h", "w", "v")


def padding_plan(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 7 + 1).cast("long").alias("h"), (F.col("p_size") * 13 + 5).cast("long").alias("w"))
    return tiling.padding_plan(sizes, 64)


def checkerboard(spark: SparkSession, d: str) -> DataFrame:
    f = field(spark, d).select("n", "h", "w", "v")
    anchors, rest = tiling.checkerboard_split(f)
    merged = tiling.checkerboard_merge(anchors, rest)
    return rounded(merged.groupBy("n", "h").agg(F.sum(F.when(tiling.parity(), F.col("v")).otherwise(0.0)).alias("anchors"), F.sum(F.col("v") * F.col("w")).alias("moment")), "anchors", "moment")


def avgpool2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiling.average_pool(field(spark, d), ["n"], SIZE), "v")


def interleave(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("h") * 8 + F.col("w")
    return rounded(field(spark, d).select("n", tiling.interleaved(c, 64, 4).cast("long").alias("c"), "v"), "v")


def color_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    unit = lambda i: F.try_divide(F.col("embedding")[i].cast("double") + 1, F.lit(2.0))
    y, cb, cr = color.rgb_to_ycbcr(unit(0), unit(1), unit(2))
    r, g, b = color.ycbcr_to_rgb(F.col("y"), F.col("cb"), F.col("cr"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), y.alias("y"), cb.alias("cb"), cr.alias("cr")).withColumns({"r": r, "g": g, "b": b})
    return rounded(rows, "y", "cb", "cr", "r", "g", "b")


def tile_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Fields to overlapped tiles, a step of a hundredth on each tile, fusion, metrics."""
    tiles = tiling.overlapped_tiles(field(spark, d), SIZE, BLOCK, STRIDE).withColumn("v", F.rint(F.col("v") * 100 + F.col("th") * 0.1) / 100)
    back = tiling.overlap_add(tiles, ["n"], BLOCK).withColumnRenamed("v", "r")
    return rounded(metrics.science_metrics(field(spark, d).join(back, ["n", "h", "w"])), "rmse", "nrmse", "maxe", "psnr")


W0 = "greatest(0.25 * (1 - cos(2 * pi() * dh / 3.0)) * (1 - cos(2 * pi() * dw / 3.0)), 1e-6)"
TILES = f"""{FIELD}, tiles AS (SELECT f.*, th, tw, h - th * 3 AS dh, w - tw * 3 AS dw FROM field f, (SELECT unnest(range(0, 3)) AS th) a, (SELECT unnest(range(0, 3)) AS tw) b
  WHERE h - th * 3 BETWEEN 0 AND 3 AND w - tw * 3 BETWEEN 0 AND 3)"""
ERR = f"""{RECON}, err AS (SELECT n, any_value(label) AS label, avg((r - v) * (r - v)) AS mse, max(abs(r - v)) AS maxe, max(v) - min(v) AS span, sqrt(avg((r - v) * (r - v))) AS rmse FROM recon GROUP BY n)"""

QUERIES = {
    "slice_stats": slice_stats, "norm_minmax": norm_minmax, "norm_meanstd": norm_meanstd, "denorm_roundtrip": denorm_roundtrip, "minmax_scaled_bits": minmax_scaled_bits, "log_quant": log_quant, "uniform_quant": uniform_quant,
    "eb_quant_shifted": eb_quant("shifted"), "eb_quant_strict": eb_quant("strict"), "symbols_dequant": symbols_dequant, "variable_step": variable_step, "truncate16": truncate16, "error_bounded_residual": error_bounded_residual,
    "science_metrics": science_metrics, "psnr_8bit": psnr_8bit, "sequence_psnr": sequence_psnr, "yuv_weighted": yuv_weighted, "residual_stats": residual_stats, "residual_hist": residual_hist, "rate_rollup": rate_rollup, "rd_loss": rd_loss,
    "ratio_and_speed": ratio_and_speed, "running_mean": running_mean, "group_by_3": group_by_3, "tile_overlap": tile_overlap, "ola_weighted": ola_weighted, "ola_overwrite": ola_overwrite, "cut_pad": cut_pad, "center_crop": center_crop,
    "padding_plan": padding_plan, "checkerboard": checkerboard, "avgpool2": avgpool2, "interleave": interleave, "color_roundtrip": color_roundtrip, "tile_metrics": tile_metrics,
}

ORACLES = {
    "slice_stats": f"WITH {STATS} SELECT n, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax, round(vmean, 6) AS vmean, round(vstd, 6) AS vstd, cells FROM stats",
    "norm_minmax": f"WITH {NORM} SELECT n, h, w, round(x, 6) AS x FROM norm",
    "norm_meanstd": f"WITH {NORM} SELECT n, h, w, round((v - vmean) / greatest(vstd, 1e-12), 6) AS x FROM norm",
    "denorm_roundtrip": f"WITH {NORM} SELECT n, max(abs(x * (vmax - vmin) + vmin - v)) < 1e-12 AS exact, count(*) AS cells FROM norm GROUP BY n",
    "minmax_scaled_bits": f"WITH {NORM}, c AS (SELECT *, least(greatest((v - vmin) / (vmax - vmin + 1e-8) * 256, 0), 32767) AS code FROM norm) SELECT n, h, w, round(code, 6) AS code, round(code / 256 * (vmax - vmin) + vmin, 6) AS back FROM c",
    "log_quant": f"WITH {FIELD}, m AS (SELECT n, max(ln(1 + abs(v))) AS most FROM field GROUP BY n), c AS (SELECT f.*, most, sign(v) * least(greatest(ln(1 + abs(v)) / most * 256, 0), 32767) AS code FROM field f JOIN m USING (n)) SELECT n, h, w, round(code, 6) AS code, round(sign(code) * (exp(abs(code) / 256 * most) - 1), 6) AS back FROM c",
    "uniform_quant": f"WITH {NORM}, c AS (SELECT *, least(greatest((v - vmean) / (CASE WHEN vstd = 0 THEN 1e-7 ELSE vstd END + 1e-7), -32768), 32767) AS code FROM norm) SELECT n, h, w, round(code, 6) AS code, round(code * vstd + vmean, 6) AS back FROM c",
    "eb_quant_shifted": f"WITH {FIELD}, c AS (SELECT *, floor(v / 0.1 + 0.5)::BIGINT - CASE WHEN v / 0.1 < -0.5 THEN 1 ELSE 0 END AS code FROM field) SELECT n, h, w, code, round(abs(code * 0.1 - v), 6) AS err FROM c",
    "eb_quant_strict": f"WITH {FIELD}, c AS (SELECT *, round_even(v / 0.1, 0)::BIGINT AS code FROM field) SELECT n, h, w, code, round(abs(code * 0.1 - v), 6) AS err FROM c",
    "symbols_dequant": f"WITH {NORM}, c AS (SELECT *, round_even(v * 16 - vmean, 0)::BIGINT AS s FROM norm) SELECT n, h, w, s, round(s + vmean, 6) AS back FROM c",
    "variable_step": f"WITH {NORM} SELECT n, h, w, round(round_even((v - vmean) / (0.01::DOUBLE * (1 + n % 4)), 0) * (0.01::DOUBLE * (1 + n % 4)) + vmean, 6) AS q FROM norm",
    "truncate16": "SELECT l_orderkey, l_linenumber, ((trunc(l_extendedprice)::BIGINT + 32768) % 65536 + 65536) % 65536 - 32768 AS q FROM lineitem",
    "error_bounded_residual": f"WITH {NORM}, c AS (SELECT *, round_even((v - vmean) / 0.02, 0)::BIGINT AS q FROM norm), p AS (SELECT n, min(q) AS qmin, max(q) AS qmax, max(abs(vmean + q * 0.02 - v)) <= 0.01 + 1e-9 AS bounded FROM c GROUP BY n) SELECT *, (CASE WHEN qmin >= -128 AND qmax < 128 THEN 8 WHEN qmin >= -32768 AND qmax < 32768 THEN 16 WHEN qmin >= -2147483648 AND qmax < 2147483648 THEN 32 ELSE 64 END)::INTEGER AS bits FROM p",
    "science_metrics": f"WITH {ERR} SELECT round(avg(rmse), 6) AS rmse, round(avg(rmse / nullif(span, 0)), 6) AS nrmse, round(max(maxe), 6) AS maxe, round(-10 * log10(nullif(avg((rmse / nullif(span, 0)) * (rmse / nullif(span, 0))), 0)), 6) AS psnr, count(*) AS slices FROM err",
    "psnr_8bit": f"WITH {NORM}, c AS (SELECT n, round_even(least(greatest(x, 0), 1) * 255, 0) - round_even(least(greatest(round_even(x * 31, 0) / 31, 0), 1) * 255, 0) AS d FROM norm), m AS (SELECT n, avg(d * d) AS mse FROM c GROUP BY n) SELECT n, round(mse, 6) AS mse, round(10 * log10(65025.0 / nullif(mse, 0)), 6) AS psnr FROM m",
    "sequence_psnr": f"WITH {ERR} SELECT label AS seq, count(*) AS frames, round(avg(10 * log10(1 / nullif(mse, 0))), 6) AS mean_of_psnr, round(10 * log10(1 / nullif(avg(mse), 0)), 6) AS psnr_of_mean FROM err GROUP BY label",
    "yuv_weighted": f"WITH {ERR}, p AS (SELECT n // 30 AS seq, (n % 30) // 3 AS frame, n % 3 AS k, 10 * log10(1 / nullif(mse, 0)) AS psnr FROM err), q AS (SELECT seq, frame, max(psnr) FILTER (k = 0) AS a, max(psnr) FILTER (k = 1) AS b, max(psnr) FILTER (k = 2) AS c FROM p GROUP BY ALL) SELECT seq, frame, round(a, 6) AS psnr_y, round(b, 6) AS psnr_u, round(c, 6) AS psnr_v, round((4 * a + b + c) / 6, 6) AS psnr_yuv FROM q",
    "residual_stats": f"WITH {RECON}, e AS (SELECT label, v - r AS d FROM recon) SELECT label, round(min(d), 9) AS dmin, round(max(d), 9) AS dmax, round(avg(d), 9) AS dmean, round(stddev_samp(d), 9) AS dstd, round(avg(abs(d)), 9) AS dabs, round(max(abs(d)), 9) AS dabsmax, round(median(d), 9) AS dmedian, round(avg(d * d), 9) AS dmse FROM e GROUP BY label",
    "residual_hist": f"WITH {RECON}, e AS (SELECT v - r AS d FROM recon) SELECT (CASE WHEN d < -0.01 THEN 0 WHEN d > 0.01 THEN 101 WHEN d = 0.01 THEN 100 ELSE floor((d - -0.01::DOUBLE) / ((0.01::DOUBLE - -0.01::DOUBLE) / 100)) + 1 END)::BIGINT AS bin, count(*) AS cells FROM e GROUP BY 1",
    "rate_rollup": f"WITH {FIELD} SELECT CASE WHEN grouping(label) = 0 THEN 's' || label::VARCHAR END AS name, round(sum(-log2(exp(-abs(v)))), 6) AS bits, round(sum(-log2(exp(-abs(v)))) / 1000.0, 6) AS bpp FROM field GROUP BY ROLLUP (label)",
    "rd_loss": f"WITH {ERR} SELECT n, round(0.01 * 65025.0 * mse + log2(1 + span / 0.01), 6) AS loss FROM err",
    "ratio_and_speed": "WITH p AS (SELECT l_shipdate, sum(l_extendedprice) AS size, sum(l_quantity) AS packed, avg(l_tax) AS seconds FROM lineitem GROUP BY l_shipdate), q AS (SELECT l_shipdate, packed * 8.0 / nullif(size, 0) AS bpp, size * 1e6 / 1073741824.0 / nullif(seconds, 0) AS gib_s, packed * 8.0 * 30 / nullif(size * 1000.0, 0) AS kbps FROM p) SELECT l_shipdate, round(bpp, 6) AS bpp, round(gib_s, 6) AS gib_s, round(kbps, 6) AS kbps, round(1 / (1 / nullif(bpp, 0) + 1 / nullif(kbps, 0)), 6) AS serial FROM q",
    "running_mean": "SELECT l_suppkey, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) AS mean FROM lineitem GROUP BY l_suppkey",
    "group_by_3": f"WITH {FIELD}, m AS (SELECT max(n) + 1 AS slices FROM field), every AS (SELECT s, i FROM (SELECT unnest(range(0, ((slices + 2) // 3) * 3)) AS s FROM m) a, (SELECT unnest(range(0, 64)) AS i) b), j AS (SELECT s // 3 AS g, s % 3 AS c, coalesce(v, 0.0) AS v FROM every LEFT JOIN field ON n = s AND h * 8 + w = i) SELECT g, c, count(*) AS cells, round(sum(v), 6) AS total FROM j GROUP BY g, c",
    "tile_overlap": f"WITH {TILES} SELECT n, th::INTEGER AS th, tw::INTEGER AS tw, count(*) AS cells, round(sum(v), 6) AS total, max(dh) AS dh, max(dw) AS dw FROM tiles GROUP BY ALL",
    "ola_weighted": f"WITH {TILES} SELECT n, h, w, round(sum((v + 0.001 * (th - tw)) * {W0}) / greatest(sum({W0}), 1e-6), 6) AS v FROM tiles GROUP BY n, h, w",
    "ola_overwrite": f"WITH {TILES} SELECT n, h, w, round(arg_max(v + 0.001 * (th * 3 + tw), th * 10 + tw), 6) AS v FROM tiles GROUP BY n, h, w",
    "cut_pad": f"WITH {FIELD}, c AS (SELECT *, h // 3 AS th, w // 3 AS tw FROM field), e AS (SELECT *, h - th * 3 + (5 - least(3, 8 - th * 3)) // 2 AS dh, w - tw * 3 + (5 - least(3, 8 - tw * 3)) // 2 AS dw FROM c) SELECT n, th, tw, count(*) AS cells, min(dh) AS top, max(dw) AS \"right\", round(sum(v), 6) AS total FROM e GROUP BY n, th, tw",
    "center_crop": f"WITH {FIELD} SELECT n, h - 1 AS h, w - 2 AS w, round(v, 6) AS v FROM field WHERE h BETWEEN 1 AND 5 AND w BETWEEN 2 AND 5",
    "padding_plan": "WITH s AS (SELECT p_partkey, (p_size * 7 + 1)::BIGINT AS h, (p_size * 13 + 5)::BIGINT AS w FROM part), m AS (SELECT *, (64 - w % 64) % 64 AS mw, (64 - h % 64) % 64 AS mh FROM s) SELECT p_partkey, h, w, mw // 2 AS \"left\", mw - mw // 2 AS \"right\", mh // 2 AS top, mh - mh // 2 AS bottom FROM m",
    "checkerboard": f"WITH {FIELD} SELECT n, h, round(sum(CASE WHEN (h + w) % 2 = 0 THEN v ELSE 0 END), 6) AS anchors, round(sum(v * w), 6) AS moment FROM field GROUP BY n, h",
    "avgpool2": f"WITH {FIELD} SELECT n, h // 2 AS h, w // 2 AS w, round(avg(v), 6) AS v FROM field GROUP BY n, h // 2, w // 2",
    "interleave": f"WITH {FIELD} SELECT n, ((h * 8 + w) % 16) * 4 + (h * 8 + w) // 16 AS c, round(v, 6) AS v FROM field",
    "color_roundtrip": "WITH u AS (SELECT vec_id AS n, (embedding[1]::DOUBLE + 1) / 2 AS r, (embedding[2]::DOUBLE + 1) / 2 AS g, (embedding[3]::DOUBLE + 1) / 2 AS b FROM embeddings), y AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y FROM u) SELECT n, round(y, 6) AS y, round(0.5 * (b - y) / 0.9278 + 0.5, 6) AS cb, round(0.5 * (r - y) / 0.7874 + 0.5, 6) AS cr, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM y",
    "tile_metrics": f"WITH {TILES}, fused AS (SELECT n, h, w, any_value(v) AS v, sum(round_even(v * 100 + th * 0.1, 0) / 100 * {W0}) / greatest(sum({W0}), 1e-6) AS r FROM tiles GROUP BY n, h, w), e AS (SELECT n, sqrt(avg((r - v) * (r - v))) AS rmse, max(abs(r - v)) AS maxe, max(v) - min(v) AS span FROM fused GROUP BY n) SELECT round(avg(rmse), 6) AS rmse, round(avg(rmse / nullif(span, 0)), 6) AS nrmse, round(max(maxe), 6) AS maxe, round(-10 * log10(nullif(avg((rmse / nullif(span, 0)) ** 2), 0)), 6) AS psnr, count(*) AS slices FROM e",
}
