"""Queries on files and byte containers, over the test tables; each with its SQL where SQL can say it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import fields, metrics, search, tiling
from ..session import new_path
from ..sources import containers, scans
from .relational import sweep
from .science import FIELD, rounded
from .tables import table

SLICES = 4  # read of each file; a file holds five


# ------------------------------------------------------------------ raw fields
def file_slices(spark: SparkSession, d: str) -> DataFrame:
    """(path, n, embedding): the slices of each file and their places in it; the last file may hold fewer, and a place may be missing."""
    rows = table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    return rows.select(F.floor(F.col("vec_id") / 5).cast("long").alias("path"), F.pmod("vec_id", F.lit(5)).cast("long").alias("n"), "embedding")


def field_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): up to five slices of 8 by 8 numbers in each headerless file, zeros where one is missing before others."""

    def packed(frames):
        for frame in frames:
            out = []
            for slices in frame["slices"]:
                content = np.zeros((max(s["n"] for s in slices) + 1, 64), dtype="<f4")
                for s in slices:
                    content[s["n"]] = s["embedding"]
                out.append(content.tobytes())
            yield pd.DataFrame({"path": frame["path"], "content": out})

    files = file_slices(spark, d).groupBy("path").agg(F.collect_list(F.struct("n", "embedding")).alias("slices"))
    return files.mapInPandas(packed, "path long, content binary")


def raw_field_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Raw files to slices, normalised, in groups of three, in overlapped tiles, a step on each tile, fused, cropped, scaled back: metrics by file."""
    size, block, stride = (8, 8), (4, 4), (3, 3)
    field = containers.decoded_field(field_files(spark, d), (SLICES, 8, 8), short=True)
    field = field.join(file_slices(spark, d).select("path", "n"), ["path", "n"], "left_semi").withColumn("k", F.col("path") * SLICES + F.col("n"))
    one = field.select("path", F.col("k").alias("n"), "h", "w", "v")
    normal = fields.normalize(one).withColumn("k", F.col("n") % SLICES)
    groups = tiling.group_by_three(normal.select("path", F.col("k").alias("n"), "h", "w", F.col("x").alias("v")), 8, 8, SLICES, by=("path",))
    tiles = tiling.overlapped_tiles(groups, size, block, stride).withColumn("v", F.rint(F.col("v") * 100 + F.col("th") * 0.1) / 100)
    fused = tiling.real_slices(tiling.overlap_add(tiles, ["path", "g", "c"], block), SLICES, ("path",))
    back = fused.select("path", (F.col("path") * SLICES + F.col("n")).alias("n"), "h", "w", F.col("v").alias("f")).join(fields.slice_stats(one), "n")
    back = back.select("path", "n", "h", "w", (F.col("f") * (F.col("vmax") - F.col("vmin")) + F.col("vmin")).alias("r"))
    e = F.col("r") - F.col("v")
    per = one.join(back, ["path", "n", "h", "w"]).groupBy("path").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("maxe"), F.count("*").alias("cells"))
    return rounded(per, "rmse", "maxe")


def fixed_images(spark: SparkSession, d: str) -> DataFrame:
    """Texts' bytes as pictures of 4 by 4 cells in three colours, one after the other: sums of each."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    images = scans.fixed_records(files, "<u1", 48)
    total = F.aggregate("values", F.lit(0.0), lambda t, x: t + x)
    return images.select(F.col("path").alias("doc_id"), F.col("record").alias("image"), total.cast("long").alias("total"), F.element_at("values", 48).cast("long").alias("last"))


def raw_video(spark: SparkSession, d: str) -> DataFrame:
    """Texts' bytes as planar video of 6 by 4 cells with halved chroma: sums and last cells of each plane of each frame."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    planes = scans.video_planes(files, 4, 6, "420")
    total = F.aggregate("values", F.lit(0.0), lambda t, x: t + x)
    return planes.select(F.col("path").alias("doc_id"), "frame", "plane", total.cast("long").alias("total"), F.element_at("values", -1).cast("long").alias("last"))


def labelled_points(spark: SparkSession, d: str) -> DataFrame:
    """Records of four floats and their side file's labels by place, looked up in a table of names."""

    def side(frames):
        place = np.arange(16)
        for frame in frames:
            label = (frame["path"].to_numpy()[:, None] * 7 + place) % 5
            pairs = np.stack([label, np.broadcast_to(place, label.shape)], axis=2).astype("<u2")
            yield pd.DataFrame({"path": frame["path"], "content": [p.tobytes() for p in pairs]})

    points = containers_of(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("path")).distinct().mapInPandas(side, "path long, content binary")
    found = scans.labelled_points(points, labels)
    names = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("label"), "r_name")
    return rounded(found.join(F.broadcast(names), "label").select(F.col("path").alias("n"), "pos", "x", "remission", "r_name", "instance"), "x", "remission")  # five names


def containers_of(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): each embedding's numbers as the bytes of a file."""

    def packed(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["vec_id"], "content": [np.asarray(e, dtype="<f4").tobytes() for e in frame["embedding"]]})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(packed, "path long, content binary")


# ------------------------------------------------------------- names, parts
def mesh_paths(spark: SparkSession, d: str) -> DataFrame:
    """Mesh files' names to label, split and number, and labels to ids in order."""
    kind = F.regexp_replace(F.lower("p_type"), r"\W+", "_")
    split = F.when(F.col("p_size") % 3 == 0, "test").otherwise("train")
    number = F.col("p_partkey").cast("string")  # six digits at least; longer ones stay whole
    path = F.concat(F.lit("/data/"), kind, F.lit("/"), split, F.lit("/"), kind, F.lit("_"), F.lpad(number, F.greatest(F.lit(6), F.length(number)), "0"), F.lit(".off"))
    facts = table(spark, d, "part").select("p_partkey", *scans.mesh_path_facts(path))
    ids = facts.groupBy("label").agg(F.count("*").alias("n")).select("label", (F.row_number().over(W.orderBy("label")) - 1).cast("long").alias("id"))  # one row per label
    return facts.join(ids, "label").select("p_partkey", "label", "split", "number", "id")


def mesh_corners(spark: SparkSession, d: str) -> DataFrame:
    """Meshes told as text to their corners."""
    line = lambda i: F.concat_ws(" ", *[F.col("embedding")[3 * i + j].cast("double").cast("string") for j in range(3)])
    text = F.concat_ws("\n", F.lit("OFF"), F.lit("# made up"), F.lit("4 0 0"), *[line(i) for i in range(4)])
    files = table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), text.alias("text"))
    return rounded(scans.mesh_corners(files).withColumnRenamed("path", "n"), "x", "y", "z")


def room_parts(spark: SparkSession, d: str) -> DataFrame:
    """Rooms of some areas only, their arrays cut into places, colours and normals, one below the other."""
    rooms = table(spark, d, "embeddings").where(F.col("label").isin(1, 2, 5)).select(F.col("vec_id").alias("n"), F.col("label").alias("area"), "embedding")
    parts = F.create_map(*[x for k, name in enumerate(("place", "colour", "normal")) for x in (F.lit(name), F.slice("embedding", 3 * k + 1, 3))])
    rows = rooms.select("n", "area", F.explode(parts).alias("part", "v"))
    total = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return rounded(rows.select("n", "area", "part", total.alias("total")), "total")


def part_labels(spark: SparkSession, d: str) -> DataFrame:
    """A file of typed columns between spaces, read back; parts are numbered anew within their class by the sum of the classes before."""
    path = new_path(spark, "files")
    order = table(spark, d, "nation").select("n_regionkey", "n_nationkey")
    order.write.option("sep", " ").csv(path)
    rows = spark.read.schema("region int, nation int").option("sep", " ").csv(path)
    sizes = rows.groupBy("region").agg(F.count("*").alias("parts"))
    before = sizes.select("region", (F.sum("parts").over(W.orderBy("region").rowsBetween(W.unboundedPreceding, 0)) - F.col("parts")).alias("offset"))  # one row per region
    within = rows.withColumn("part", (F.row_number().over(W.partitionBy("region").orderBy("nation")) - 1).cast("long"))
    return within.join(before, "region").select("region", "nation", "part", (F.col("offset") + F.col("part")).alias("semantic"))


def array_zip(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of one length side by side."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), "embedding", F.reverse("embedding").alias("back"))
    pairs = scans.zipped(rows, "embedding", "back")
    return rounded(pairs.groupBy("n").agg(F.sum(F.col("embedding").cast("double") * F.col("back").cast("double") * F.col("i")).alias("moment")), "moment")


def cached_totals(spark: SparkSession, d: str) -> DataFrame:
    """A table that is made once and read from then on."""
    path = new_path(spark, "cached")
    make = lambda: table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

    def never() -> DataFrame:
        raise AssertionError("made twice")

    scans.cached(spark, path, make)
    return scans.cached(spark, path, never)


# ------------------------------------------------------------------- containers
def body_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Bodies packed and taken apart."""
    body = containers.packed_body(F.col("p_size"), F.col("p_size") * 2, [F.col("p_brand"), F.lit(""), F.col("p_type")])
    rows = table(spark, d, "part").select("p_partkey", body.alias("body")).select("p_partkey", *containers.body_fields(F.col("body")))
    text = lambda i: F.decode(F.get("parts", F.lit(i)), "UTF-8")
    return rows.select("p_partkey", "h", "w", F.size("parts").cast("long").alias("parts"), text(0).alias("brand"), text(1).alias("nothing"), text(2).alias("kind"))


def plane_container(spark: SparkSession, d: str) -> DataFrame:
    """Containers of planes packed and read: header fields and payload."""
    raw = containers.packed_planes(F.col("p_size") * 100, F.col("p_size") * 50, F.lit(3), F.col("p_size"), F.lit(511), F.lit(8), F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", F.octet_length("raw").cast("long").alias("bytes"), *containers.plane_fields(F.col("raw")))
    return rows.withColumn("payload", F.decode("payload", "UTF-8"))


def chunk_payload(spark: SparkSession, d: str) -> DataFrame:
    """Chunks laid end to end by brand and size, then single ones read by their offsets."""
    key = F.concat_ws("|", "p_brand", F.col("p_size").cast("string"))
    chunks = table(spark, d, "part").select(key.alias("pack"), F.col("p_partkey").alias("chunk"), F.col("p_name").cast("binary").alias("bytes"))
    packs = containers.laid_out(chunks, "pack")
    last = F.size("offsets") - 1
    return packs.select("pack", F.octet_length("payload").cast("long").alias("size"), F.element_at("offsets", -1).alias("last_offset"), F.decode(containers.chunk_of(F.col("payload"), F.col("offsets"), last), "UTF-8").alias("last"), F.sha2("payload", 256).alias("sha256"))


def pack_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of nested packs by stream, by pack and on the whole."""
    packs = table(spark, d, "part").select("p_brand", F.create_map(F.lit("y"), F.array(F.col("p_name").cast("binary"), F.col("p_type").cast("binary")), F.lit("z"), F.array(F.col("p_brand").cast("binary"))).alias("streams"))
    return containers.stream_sizes(packs, "p_brand", "streams")


def file_rates(spark: SparkSession, d: str) -> DataFrame:
    """Bits a cell of whole files, header and lengths included, and of their payload alone; sizes out of range raise."""
    h, w = search.in_range(F.col("p_size"), 1, 4096, "height"), search.in_range(F.col("p_size") * 2, 1, 4096, "width")
    file = F.concat(containers.packed_header(F.col("p_partkey") % 256, F.lit(1), F.col("p_size") % 8 + 1), containers.packed_body(h, w, [F.col("p_name"), F.col("p_type")]))
    cells = h * w
    payload = F.octet_length("p_name") + F.octet_length("p_type")
    return rounded(table(spark, d, "part").select("p_partkey", metrics.bits_per_cell(F.octet_length(file), cells).alias("bpp_file"), metrics.bits_per_cell(payload, cells).alias("bpp")), "bpp_file", "bpp")


# ----------------------------------------------------------------- result files
def result_files(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps written as result files, half of them under a wrapper, and read back."""
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("q", c))), lambda x: x[c])
    lists = sweep(spark, d).withColumn("rmse", F.round("rmse", 9)).withColumn("bits", F.round("bits", 6)).withColumn("near", F.round(1 - F.col("rmse"), 9))
    lists = lists.groupBy("label").agg(ordered("rmse").alias("rmse"), ordered("bits").alias("bpp"), ordered("near").alias("ms-ssim"))
    bare = F.to_json(F.struct("rmse", "bpp", "ms-ssim"))
    told = F.to_json(F.struct(F.lit("codec").alias("description"), F.struct("rmse", "bpp", "ms-ssim").alias("results")))
    path = new_path(spark, "results")
    scans.write_results(lists.select(F.concat(F.lit("codec-"), F.col("label").cast("string")).alias("name"), F.when(F.col("label") % 2 == 0, told).otherwise(bare).alias("json")), path)
    return rounded(scans.read_results(spark, path), "value", places=5)


def result_means(spark: SparkSession, d: str) -> DataFrame:
    """Means over all result files at each setting."""
    return rounded(scans.run_means(result_files(spark, d)), "mean", places=3)


def benchmark_csv(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark rows written as CSV with a header, twice, read back once each."""
    rows = sweep(spark, d).select(F.concat(F.lit("set, "), F.col("label").cast("string")).alias("dataset"), F.col("q").cast("int").alias("quality"), F.lit("q").alias("sweep"), F.round("bits", 5).alias("bpp"), F.round(-20 * F.log10("rmse"), 5).alias("psnr"))
    path = new_path(spark, "csv")
    for mode in ("errorifexists", "append"):
        rows.write.option("header", "true").mode(mode).csv(path)
    return scans.read_benchmark(spark, path)


QUERIES = {f.__name__: f for f in (raw_field_metrics, fixed_images, raw_video, labelled_points, mesh_paths, mesh_corners, room_parts, part_labels, array_zip, cached_totals, body_roundtrip, plane_container, chunk_payload, pack_sizes, file_rates, result_files, result_means, benchmark_csv)}

BYTES = "bytes AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM documents)"
SUM_OF = "list_sum(list_transform(range({0}, {1}), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT))::BIGINT"
BYTE_AT = "('0x' || substr(x, 2 * ({0}) + 1, 2))::BIGINT"
KIND = r"regexp_replace(lower(p_type), '\W+', '_', 'g')"
SPLIT = "CASE WHEN p_size % 3 = 0 THEN 'test' ELSE 'train' END"
SWEEP = f"""{FIELD}, sweep AS (SELECT label, q, round(sqrt(avg((v - round_even(v * q, 0) / q) * (v - round_even(v * q, 0) / q))), 9) AS rmse, sum(log2(1 + abs(round_even(v * q, 0)))) AS bits
  FROM field, (SELECT unnest(range(1, 9)) AS q) s GROUP BY label, q)"""
RESULTS = f"""{SWEEP}, rows AS (SELECT 'codec-' || label AS name, 'rmse' AS metric, q - 1 AS i, round(rmse, 5) AS value FROM sweep UNION ALL SELECT 'codec-' || label, 'bpp', q - 1, round(bits, 5) FROM sweep
  UNION ALL SELECT 'codec-' || label, 'ms-ssim-rgb', q - 1, round(-10 * log10(nullif(1 - round(1 - rmse, 9), 0)), 5) FROM sweep)"""
W0 = "greatest(0.25 * (1 - cos(2 * pi() * dh / 3.0)) * (1 - cos(2 * pi() * dw / 3.0)), 1e-6)"

ORACLES = {
    "raw_field_metrics": f"""WITH {FIELD}, own AS (SELECT n // 5 AS path, n, h, w, v FROM field WHERE n % 5 < {SLICES}), s AS (SELECT n, min(v) AS lo, max(v) AS hi FROM own GROUP BY n),
      x AS (SELECT own.*, lo, hi, (v - lo) / greatest(hi - lo, 1e-12) AS x FROM own JOIN s USING (n)),
      t AS (SELECT x.*, th, h - th * 3 AS dh, w - tw * 3 AS dw FROM x, (SELECT unnest(range(0, 3)) AS th) a, (SELECT unnest(range(0, 3)) AS tw) b WHERE h - th * 3 BETWEEN 0 AND 3 AND w - tw * 3 BETWEEN 0 AND 3),
      f AS (SELECT path, n, h, w, any_value(v) AS v, any_value(lo) AS lo, any_value(hi) AS hi, sum(round_even(x * 100 + th * 0.1, 0) / 100 * {W0}) / greatest(sum({W0}), 1e-6) AS f FROM t GROUP BY path, n, h, w),
      e AS (SELECT path, f * (hi - lo) + lo - v AS e FROM f) SELECT path, round(sqrt(avg(e * e)), 6) AS rmse, round(max(abs(e)), 6) AS maxe, count(*) AS cells FROM e GROUP BY path""",
    "fixed_images": f"WITH {BYTES} SELECT doc_id, image, {SUM_OF.format('image * 48', 'image * 48 + 48')} AS total, {BYTE_AT.format('image * 48 + 47')} AS last FROM (SELECT *, unnest(range(0, n // 48)) AS image FROM bytes)",
    "raw_video": f"""WITH {BYTES}, f AS (SELECT *, unnest(range(0, n // 36)) AS frame FROM bytes), p AS (SELECT 'y' AS plane, 0 AS a, 24 AS b UNION ALL SELECT 'u', 24, 30 UNION ALL SELECT 'v', 30, 36)
      SELECT doc_id, frame, plane, {SUM_OF.format('frame * 36 + a', 'frame * 36 + b')} AS total, {BYTE_AT.format('frame * 36 + b - 1')} AS last FROM f, p""",
    "labelled_points": "SELECT vec_id AS n, pos, round(embedding[pos * 4 + 1]::DOUBLE, 6) AS x, round(embedding[pos * 4 + 4]::DOUBLE, 6) AS remission, r_name, pos AS instance FROM embeddings, (SELECT unnest(range(0, 16)) AS pos) p JOIN region ON r_regionkey = (vec_id * 7 + pos) % 5",
    "mesh_paths": f"WITH m AS (SELECT p_partkey, {KIND} AS label, {SPLIT} AS split FROM part) SELECT p_partkey, label, split, p_partkey AS number, dense_rank() OVER (ORDER BY label) - 1 AS id FROM m",
    "mesh_corners": "SELECT vec_id AS n, vertex, round(embedding[vertex * 3 + 1]::DOUBLE, 6) AS x, round(embedding[vertex * 3 + 2]::DOUBLE, 6) AS y, round(embedding[vertex * 3 + 3]::DOUBLE, 6) AS z FROM embeddings, (SELECT unnest(range(0, 4)) AS vertex) v",
    "room_parts": "SELECT vec_id AS n, label AS area, part, round(embedding[k + 1]::DOUBLE + embedding[k + 2]::DOUBLE + embedding[k + 3]::DOUBLE, 6) AS total FROM embeddings, (SELECT 'place' AS part, 0 AS k UNION ALL SELECT 'colour', 3 UNION ALL SELECT 'normal', 6) p WHERE label IN (1, 2, 5)",
    "part_labels": "SELECT n_regionkey AS region, n_nationkey AS nation, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS part, (row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1)::BIGINT AS semantic FROM nation",
    "array_zip": "SELECT vec_id AS n, round(sum(embedding[i + 1]::DOUBLE * embedding[64 - i]::DOUBLE * i), 6) AS moment FROM embeddings, (SELECT unnest(range(0, 64)) AS i) s GROUP BY vec_id",
    "cached_totals": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "body_roundtrip": "SELECT p_partkey, p_size::BIGINT AS h, p_size::BIGINT * 2 AS w, 3::BIGINT AS parts, p_brand AS brand, '' AS nothing, p_type AS kind FROM part",
    "plane_container": "SELECT p_partkey, 13 + octet_length(encode(p_name))::BIGINT AS bytes, p_size::BIGINT * 100 AS width, p_size::BIGINT * 50 AS height, 3::BIGINT AS depth, p_size::BIGINT AS channels, 511::BIGINT AS symbols, 8::BIGINT AS bits, p_name AS payload FROM part",
    "chunk_payload": "SELECT p_brand || '|' || p_size AS pack, sum(octet_length(encode(p_name)))::BIGINT AS size, (sum(octet_length(encode(p_name))) - octet_length(encode(arg_max(p_name, p_partkey))))::BIGINT AS last_offset, arg_max(p_name, p_partkey) AS last, sha256(string_agg(p_name, '' ORDER BY p_partkey)) AS sha256 FROM part GROUP BY p_brand, p_size",
    "pack_sizes": "WITH s AS (SELECT p_brand, 'y' AS stream, octet_length(encode(p_name)) + octet_length(encode(p_type)) AS n FROM part UNION ALL SELECT p_brand, 'z', octet_length(encode(p_brand)) FROM part) SELECT p_brand, stream, sum(n)::BIGINT AS size FROM s GROUP BY ROLLUP (p_brand, stream)",
    "file_rates": "SELECT p_partkey, round((octet_length(encode(p_name)) + octet_length(encode(p_type)) + 22) * 8.0::DOUBLE / (p_size * p_size * 2), 6) AS bpp_file, round((octet_length(encode(p_name)) + octet_length(encode(p_type))) * 8.0::DOUBLE / (p_size * p_size * 2), 6) AS bpp FROM part",
    "result_files": f"WITH {RESULTS} SELECT name, metric, i::BIGINT AS i, value FROM rows",
    "result_means": f"WITH {RESULTS} SELECT metric, i::BIGINT AS i, round(avg(value), 3) AS mean, count(*) AS runs FROM rows GROUP BY metric, i",
    "benchmark_csv": f"WITH {SWEEP} SELECT 'set, ' || label AS dataset, q::INTEGER AS quality, 'q' AS sweep, round(bits, 5) AS bpp, round(-20 * log10(rmse), 5) AS psnr FROM sweep",
}
