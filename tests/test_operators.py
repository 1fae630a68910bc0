"""Known answers, inverses and edge cases of single operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.operators import coder, entropy, fields, images, metrics, points, quantize, search, tiling
from fieldloom.sources import containers, scans, video
from fieldloom.streaming import windows


def test_quantised_cdf_known_answer():
    assert coder.quantized_cdf([0.1, 0.2, 0.0, 0.0]) == [0, 21845, 65534, 65535, 65536]


@pytest.mark.parametrize("masses", [[-0.1, 0.5], [float("inf")], [float("-inf"), 1.0], [float("nan")], [0.0, 0.0], []])
def test_quantised_cdf_refuses(masses):
    with pytest.raises(ValueError):
        coder.quantized_cdf(masses)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=60).filter(lambda p: sum(p) > 1e-3))
def test_quantised_cdf_is_open_and_full(p):
    p = [x / sum(p) for x in p]
    bounds = coder.quantized_cdf(p)
    assert bounds[0] == 0 and bounds[-1] == 65536 and all(a < b for a, b in zip(bounds, bounds[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-40, 40), min_size=1, max_size=300), st.lists(st.integers(-(2**40), 2**40), max_size=5))
def test_coder_round_trip(symbols, outside):
    bounds, low = coder.bounds_of(np.array(symbols))
    told = symbols + outside
    assert coder.decode(coder.encode(told, bounds, low), len(told), bounds, low) == told


def test_scale_table_ends():
    table = entropy.scale_table()
    assert len(table) == 64 and math.isclose(table[0], 0.11) and math.isclose(table[-1], 256)


def test_error_function(spark):
    xs = [-3.0, -0.5, 0.0, 0.3, 2.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(entropy.erfc(F.col("x")).alias("e")).collect()
    assert all(abs(r["e"] - math.erfc(x)) < 2e-7 for r, x in zip(got, xs, strict=True))


def field_of(spark, n, h, w, value):
    return spark.createDataFrame([(k, i, j, float(value(k, i, j))) for k in range(n) for i in range(h) for j in range(w)], "n long, h long, w long, v double")


@pytest.mark.parametrize(("h", "w", "block", "stride"), [(5, 7, (4, 4), (3, 2)), (2, 9, (4, 4), (1, 3)), (8, 8, (3, 5), (2, 4))])
def test_overlap_add_gives_back_what_was_tiled(spark, h, w, block, stride):
    f = field_of(spark, 2, h, w, lambda k, i, j: math.sin(k + 3 * i + j))
    tiles = tiling.overlapped_tiles(f, (h, w), block, stride)
    for back in (tiling.overlap_add(tiles, ["n"], block), tiling.overwrite(tiles, ["n"])):
        joined = f.join(back.withColumnRenamed("v", "r"), ["n", "h", "w"])
        assert joined.count() == 2 * h * w
        assert joined.agg(F.max(F.abs(F.col("v") - F.col("r")))).first()[0] < 1e-12
    assert tiles.select("th", "tw").distinct().count() == tiling.tile_count(h, block[0], stride[0]) * tiling.tile_count(w, block[1], stride[1])


def test_stride_must_overlap():
    with pytest.raises(ValueError):
        tiling.tile_count(8, 4, 4)


def test_checkerboard_is_reversible(spark):
    f = field_of(spark, 1, 5, 6, lambda k, i, j: 10 * i + j)
    for anchor in (0, 1):
        back = tiling.checkerboard_merge(*tiling.checkerboard_split(f, anchor), anchor)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, f.collect()))


def test_group_by_three_fills_the_tail(spark):
    got = tiling.group_by_three(field_of(spark, 4, 2, 2, lambda *_: 1), 2, 2, 4, pad=-1.0)
    assert got.count() == 24 and got.where("v = -1").count() == 8


def test_constant_slice(spark):
    rows = fields.normalize(field_of(spark, 1, 2, 2, lambda *_: 3)).withColumn("r", fields.denormalized(F.col("x")))
    assert {(r["x"], r["r"]) for r in rows.collect()} == {(0.0, 3.0)}
    assert metrics.slice_errors(rows).first()["nrmse"] is None


def test_nulls_are_left_out_of_statistics(spark):
    f = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, None), (1, 0, 0, None)], "n long, h long, w long, v double")
    got = {r["n"]: r for r in fields.slice_stats(f).collect()}
    assert got[0]["cells"] == 1 and got[1]["vmin"] is None


def test_quantiser_modes(spark):
    xs = spark.createDataFrame([(x,) for x in (-2.2, -0.7, -0.5, 0.5, 1.5)], "x double")
    got = xs.select(quantize.eb_code(F.col("x"), 0.5).alias("a"), quantize.eb_code(F.col("x"), 0.5, "shifted").alias("b")).collect()
    assert [r["a"] for r in got] == [-2, -1, 0, 0, 2]
    assert [r["b"] for r in got] == [-3, -2, 0, 1, 2]


def test_header_and_body(spark):
    df = spark.createDataFrame([(7, 2, 5)], "m int, k int, q int").withColumn("h", containers.packed_header(F.col("m"), F.col("k"), F.col("q")))
    assert tuple(df.select(*containers.header_fields(F.col("h"))).first()) == (7, 2, 5)
    body = df.select(containers.packed_body(F.lit(3), F.lit(4), [F.lit("ab"), F.lit("")]).alias("b")).first()["b"]
    assert bytes(body) == bytes.fromhex("00000003 00000004 00000002 00000002 6162 00000000")


def test_raw_field(spark, tmp_path):
    values = np.arange(2 * 3 * 4 + 5, dtype="<f4")
    values.tofile(tmp_path / "a.f32")
    got = containers.raw_field(spark, str(tmp_path), (2, 3, 4))
    assert got.count() == 24 and all(r["v"] == r["n"] * 12 + r["h"] * 4 + r["w"] for r in got.collect())


def test_video_names(spark):
    names = ["Race_832x480_30Hz_8bit_P420.yuv", "x_1920x1080_59.94fps_10bit_yuv422.yuv"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(*video.raw_video_info(F.col("name"))).collect()
    assert tuple(rows[0])[:5] == (832, 480, 30.0, 8, "420")
    assert tuple(rows[1])[:5] == (1920, 1080, 59.94, 10, "422")


def test_unknown_key_raises(spark):
    rows, table = spark.createDataFrame([(1,), (9,)], "key int"), spark.createDataFrame([(1, "a")], "key int, to string")
    with pytest.raises(Exception, match="unknown key"):
        search.remapped(rows, "key", table, "to").collect()


def test_neighbours_break_ties_by_number(spark):
    c = spark.createDataFrame([(0, p, float(x), 0.0, 0.0) for p, x in enumerate((0, 1, -1, 1))], "cloud int, p long, x double, y double, z double")
    got = points.neighbours(c.where("p = 0"), c, 3).orderBy("rank").collect()
    assert [r["b_p"] for r in got] == [0, 1, 2]


def test_sphere_and_rotation(spark):
    rows = points.sphere_mesh(spark, 1).collect()
    v = np.array([[r["x"], r["y"], r["z"]] for r in rows])
    assert len({r["face"] for r in rows}) == 80 and len(rows) == 240 and len(np.unique(np.round(v, 9), axis=0)) == 42
    assert np.allclose(np.linalg.norm(v, axis=1), 1)
    r = np.array(points.random_rotation(3))
    assert np.allclose(r @ r.T, np.eye(3)) and math.isclose(np.linalg.det(r), 1)


def test_empty_tables(spark):
    f = field_of(spark, 1, 2, 2, lambda *_: 0).where("false")
    assert fields.normalize(f).count() == 0
    assert metrics.science_metrics(f.withColumn("r", F.col("v"))).first()["slices"] == 0
    assert tiling.overlapped_tiles(f, (2, 2), (2, 2), (1, 1)).count() == 0


def cloud_of(spark, rows):
    return spark.createDataFrame(rows, "cloud long, p long, x double, y double, z double")


@pytest.mark.parametrize("self_too", [True, False])
def test_neighbours_are_those_of_all_pairs(spark, self_too):
    """Crowded places, far outliers, small clouds and queries outside, by brute force."""
    rng = np.random.default_rng(4)
    rows = [(0, i, *map(float, rng.normal(size=3))) for i in range(60)] + [(0, 100 + i, 0.5, 0.5, 0.5) for i in range(12)] + [(0, 200, 90.0, 0.0, 0.0)]
    rows += [(1, 1, 0.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.0), (2, 5, 3.0, 3.0, 3.0)] + [(3, i, float(i), 0.0, 0.0) for i in range(20)]
    asked = [*rows, (0, 900, -40.0, 7.0, 3.0), (3, 901, 100.0, 1.0, 1.0)]
    got = sorted(tuple(r) for r in points.neighbours(cloud_of(spark, asked), cloud_of(spark, rows), 4, self_too).select("cloud", "p", "rank", "b_p").collect())
    want = []
    for c, p, *x in asked:
        near = sorted((sum((a - b) * (a - b) for a, b in zip(x, y, strict=True)), q) for d, q, *y in rows if d == c and (self_too or q != p))
        want += [(c, p, k + 1, q) for k, (_, q) in enumerate(near[:4])]
    assert got == sorted(want)


def test_farthest_points_one_at_a_time(spark):
    rng = np.random.default_rng(5)
    rows = [(c, i, *map(float, rng.integers(0, 4, 3))) for c in range(3) for i in range(3 + 20 * c)]
    got = sorted(tuple(r) for r in points.farthest_points(cloud_of(spark, rows), 6).collect())
    want = []
    for c in range(3):
        own = [r for r in rows if r[0] == c]
        least, at = [float("inf")] * len(own), 0
        for pick in range(6):
            want.append((c, pick, own[at][1]))
            least = [min(d, sum((a - b) ** 2 for a, b in zip(r[2:], own[at][2:], strict=True))) for d, r in zip(least, own, strict=True)]
            at = max(range(len(own)), key=lambda i: (least[i], -i))
            if least[at] == 0:
                break
    assert got == sorted(want)


def test_surface_points_follow_the_areas(spark):
    faces = spark.createDataFrame([(1, k, *[[float(x) for x in p] for p in t]) for k, t in enumerate((((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((0, 0, 1), (3, 0, 1), (0, 3, 1)), ((0, 0, 2),) * 3))], "mesh long, face long, a array<double>, b array<double>, c array<double>")
    got = points.surface_points(faces, 2000).collect()
    assert len(got) == 2000 and {r["face"] for r in got} == {0, 1}
    assert abs(sum(r["face"] == 1 for r in got) / 2000 - 0.9) < 0.03
    assert all(r["z"] == r["face"] and r["x"] >= 0 and r["y"] >= 0 and r["x"] + r["y"] <= (3 if r["face"] else 1) + 1e-9 for r in got)


def test_greedy_order(spark):
    costs = spark.createDataFrame([(0, None, 9.0), (1, None, 5.0), (2, None, 7.0), (0, 1, 1.0), (2, 0, 0.5), (2, 1, 6.0)], "part long, given long, bits double")
    assert search.greedy_order(costs, [0, 1, 2, 3]) == [1, 0, 2, 3]


def test_prefix_sums_by_stretches(spark):
    rows = spark.createDataFrame([("a", i * 7 % 101, i) for i in range(101)] + [("b", 3, 5)], "g string, o long, v long")
    plain, dealt = (sorted(map(tuple, entropy.prefix_sums(rows, "g", "o", "v", width=w).select("g", "o", "before", "through").collect())) for w in (None, 10))
    assert plain == dealt


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-30, 30), min_size=2, max_size=120), st.integers(1, 7))
def test_a_decoder_goes_on_where_it_ended(told, step):
    bounds, low = coder.bounds_of(np.array(told[: len(told) // 2]))
    stream, got, state = coder.encode(told, bounds, low), [], None
    while len(got) < len(told):
        decoder = coder.Decoder(stream, state)
        got += decoder.take(min(step, len(told) - len(got)), bounds, low)
        state = (decoder.state, decoder.at)
    assert got == told


def test_body_that_ends_too_soon_and_other_containers_raise(spark):
    rows = spark.createDataFrame([(bytearray.fromhex("0000000100000002000000010000000541"),)], "b binary")
    for made in (containers.body_fields, containers.plane_fields):
        with pytest.raises(Exception, match="too soon|not a container"):
            rows.select(*made(F.col("b"))).collect()


def picture(h, w):
    """A PNG of one grey."""
    import struct
    import zlib

    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress((b"\0" + b"\x40" * 3 * w) * h)) + part(b"IEND", b"")


def test_listings_and_pictures(spark, tmp_path):
    (tmp_path / "train" / "deep").mkdir(parents=True)
    (tmp_path / "train" / "b.png").write_bytes(picture(2, 3))
    (tmp_path / "train" / "a.PNG").write_bytes(picture(4, 5))
    (tmp_path / "train" / "deep" / "c.jpeg").write_bytes(b"x")
    (tmp_path / "train" / "notes.txt").write_bytes(b"x")
    names = lambda deep: sorted(r["path"].rsplit("/", 1)[1] for r in scans.listed(spark, str(tmp_path / "train"), deep=deep).collect())
    assert names(True) == ["a.PNG", "b.png", "c.jpeg"] and names(False) == ["a.PNG", "b.png"]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.png").write_bytes(picture(4, 5))
    got = scans.pictures(spark, str(tmp_path), "one").first()
    assert (got["height"], got["width"], got["channels"], set(got["data"])) == (4, 5, 3, {0x40})
    with pytest.raises(Exception, match="(?i)not exist"):
        scans.listed(spark, str(tmp_path / "none")).collect()


def test_fixed_records_and_planes(spark):
    files = spark.createDataFrame([("a", bytearray(range(25))), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    assert [(r["path"], r["record"], r["values"]) for r in scans.fixed_records(files, "<u2", 6).collect()] == [("a", k, [float(2 * i + 256 * (2 * i + 1)) for i in range(6 * k, 6 * k + 6)]) for k in range(2)]
    cells = scans.plane_cells(scans.video_planes(files, 3, 3, "420")).where("plane = 'v'").orderBy("h", "w").collect()
    assert [(r["h"], r["w"], r["v"]) for r in cells] == [(0, 0, 13.0), (0, 1, 14.0), (1, 0, 15.0), (1, 1, 16.0)]
    assert scans.plane_sizes(5, 5, "400") == [("y", 5, 5)] and scans.plane_sizes(5, 5, "422")[1] == ("u", 5, 3)


def test_arrays_of_other_lengths_and_keyless_rows_raise(spark, tmp_path):
    with pytest.raises(Exception, match="differ in length"):
        scans.zipped(spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>"), "a", "b").collect()
    (tmp_path / "b.csv").write_text("dataset,quality,sweep,bpp,psnr\n,1,q,0.5,30\n")
    with pytest.raises(Exception, match="without its key"):
        scans.read_benchmark(spark, str(tmp_path)).collect()


def test_a_sample_wraps_and_repeats_are_one(spark):
    rows = spark.createDataFrame([("a", i) for i in (1, 1, 2, 3)] + [("b", i) for i in range(9)], "g string, k long")
    got = search.random_sample(rows, "g", "k", 5).collect()
    for g, n in (("a", 3), ("b", 9)):
        own = [r["k"] for r in sorted(got, key=lambda r: r["draw"]) if r["g"] == g]
        assert len(own) == 5 and len(set(own)) == min(5, n) and own[3:] == (own[:2] if n == 3 else own[3:])


def test_chroma_modes_and_ramps_are_checked(spark):
    plane = field_of(spark, 1, 2, 2, lambda k, i, j: i + j)
    with pytest.raises(ValueError):
        images.chroma_doubled(plane, ["n"], (2, 2), "cubic")
    with pytest.raises(ValueError):
        images.ramp(1, 2, 3, "square")
    with pytest.raises(ValueError):
        images.center_pad(plane, ["n"], (2, 2), (1, 4))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-60, 60), st.integers(0, 3)), max_size=80))
def test_indexed_coder_round_trip(pairs):
    laws = coder.normal_tables([0.11, 0.7, 3.0, 9.0])
    tables, offsets = laws["bounds"].tolist(), laws["offset"].tolist()
    told, which = [a for a, _ in pairs], [b for _, b in pairs]
    assert coder.Decoder(coder.encode_indexed(told, which, tables, offsets)).take_indexed(which, tables, offsets) == told


def test_values_out_of_range_raise(spark):
    rows = spark.createDataFrame([(1,), (None,), (8,)], "q int")
    assert [r[0] for r in rows.select(search.in_range(F.col("q"), 1, 8, "quality")).collect()] == [1, None, 8]
    with pytest.raises(Exception, match="quality must lie in"):
        rows.select(search.in_range(F.col("q"), 1, 7, "quality")).collect()


def test_short_raw_files(spark):
    values = np.arange(30, dtype="<f4")
    files = spark.createDataFrame([(1, bytearray(values.tobytes())), (2, bytearray(values[:13].tobytes())), (3, bytearray(values[:5].tobytes()))], "path long, content binary")
    got = containers.decoded_field(files, (2, 3, 4), short=True).groupBy("path").agg(F.count("*").alias("cells"), F.max("v").alias("last")).orderBy("path").collect()
    assert [tuple(r) for r in got] == [(1, 24, 23.0), (2, 12, 11.0)]
    with pytest.raises(Exception, match="too few"):
        containers.decoded_field(files, (2, 3, 4)).collect()


def test_records_of_short_files_go_out_together(spark, monkeypatch):
    """Parts of long files and many short files in one batch keep their paths and numbers."""
    files = spark.createDataFrame([(p, bytearray([p % 250] * (4 * (p % 3)))) for p in range(500)] + [(900, bytearray(range(200)) * 4)], "path long, content binary").coalesce(1)
    monkeypatch.setattr(scans, "MOST_VALUES", 30)
    got = sorted((r["path"], r["record"], tuple(r["values"])) for r in scans.fixed_records(files, "<u1", 4).collect())
    assert got == sorted([(p, k, (float(p % 250),) * 4) for p in range(500) for k in range(p % 3)] + [(900, k, tuple(float((4 * k + i) % 200) for i in range(4))) for k in range(200)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=1, max_size=60), min_size=1, max_size=12), st.lists(st.integers(-300, 300), min_size=1, max_size=40))
def test_streams_side_by_side_are_those_alone(streams, other):
    made = [coder.bounds_of(np.array(s)) for s in streams]
    alone = [coder.encode(s, *m) for s, m in zip(streams, made, strict=True)]
    flat = [(b[x - low], b[x - low + 1] - b[x - low]) for s, (b, low) in zip(streams, made, strict=True) for x in s]
    starts, widths = (np.array(x) for x in zip(*flat, strict=True))
    assert coder.lanes_encoded(starts, widths, np.array([len(s) for s in streams])) == alone
    # one more whose symbols lie outside its table
    streams, made, alone = [*streams, other], [*made, made[0]], [*alone, coder.encode(other, *made[0])]
    got = coder.lanes_decoded(alone, np.array([len(s) for s in streams]), [b for b, _ in made], np.array([low for _, low in made]))
    assert [g.tolist() for g in got] == streams


def test_many_streams_in_few_groups(spark, monkeypatch):
    """Short and long streams, null keys, and streams over several batches; no group of its own for each stream."""
    monkeypatch.setattr(coder, "LANES", 100)
    made = [(k if k % 7 else None, i, (k * i) % 11 - 3) for k in range(40) for i in range(1 + 13 * (k % 5))] + [(99, i, i % 3) for i in range(900)]
    rows = coder.chunked(spark.createDataFrame(made, "s long, i long, sym long"), "i", 300)
    encoded = coder.encode_streams(rows, "s", ["i", "sym"])
    assert "FlatMapGroupsInPandas" not in encoded._jdf.queryExecution().toString()
    back = coder.decode_streams(encoded, "s").select("s", (F.col("chunk") * 300 + F.col("pos")).alias("i"), "sym")
    one = rows.where("s is not null").select("s", "i", "sym")
    assert back.where("s is not null").exceptAll(one).count() == 0 == one.exceptAll(back.where("s is not null")).count()
    assert coder.checked_streams(encoded, "s").where("same").agg(F.sum("n")).first()[0] == len(made)


def test_requests_of_many_streams_share_their_state(spark, tmp_path):
    """Two runs over requests: each stream goes on where it ended, whatever lies in its bucket; few rows of state."""
    told = {f"s{k}": [(k * i) % 9 - 4 for i in range(5 + k)] for k in range(20)}
    first, later = [], []
    for name, syms in told.items():
        bounds, low = coder.bounds_of(np.array(syms))
        first.append((name, 0, 3, bounds, low, bytearray(coder.encode(syms, bounds, low))))
        later += [(name, s, min(4, len(syms) - 4 * s + 1), bounds, low, None) for s in range(1, (len(syms) - 3 + 3) // 4 + 1)]
    schema = "stream_id string, seq long, n long, bounds array<int>, low long, stream binary"
    for part in (first, later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = windows.written_stream(windows.decoded_requests(stream, 3), str(tmp_path / "out"), str(tmp_path / "state"))
    back = {name: [r["sym"] for r in got.where(F.col("stream_id") == name).orderBy("i").collect()] for name in told}
    assert back == told
    rows = spark.read.format("statestore").load(str(tmp_path / "state"))
    assert 0 < rows.count() <= 3


def test_ended_streams_leave_no_state(spark, tmp_path):
    """A stream's state goes with its last request; that of the others holds the bytes that aren't read yet."""
    told = {f"s{k}": [(k * i) % 9 - 4 for i in range(5 + 30 * k)] for k in range(20)}
    parts, size = ([], []), 0
    for name, syms in told.items():
        bounds, low = coder.bounds_of(np.array(syms))
        stream = bytearray(coder.encode(syms, bounds, low))
        ends = len(syms) <= 300
        size += 0 if ends else len(stream)
        parts[0].append((name, 0, min(300, len(syms)), bounds, low, stream, ends))
        parts[1].extend([] if ends else [(name, 1, len(syms) - 300, bounds, low, None, True)])
    schema = "stream_id string, seq long, n long, bounds array<int>, low long, stream binary, last boolean"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = windows.written_stream(windows.decoded_requests(stream, 3), str(tmp_path / "out"), str(tmp_path / "state"))
        held = spark.read.format("statestore").load(str(tmp_path / "state")).select(F.explode(F.arrays_zip("value.groupState.stream_id", "value.groupState.stream")).alias("s")).select("s.*").collect()
        assert {r["stream_id"] for r in held} == ({n for n, syms in told.items() if len(syms) > 300} if k == 0 else set())
        assert k or 0 < sum(len(r["stream"]) for r in held) < size / 2
    back = {name: [r["sym"] for r in got.where(F.col("stream_id") == name).orderBy("i").collect()] for name in told}
    assert back == told


def test_ball_queries_are_those_of_all_pairs(spark, monkeypatch):
    """Crowded cells whose first points lie out of reach, lone points, queries elsewhere: by brute force, with few points in the first round."""
    monkeypatch.setattr(points, "FIRST_HELD", 4)
    rng = np.random.default_rng(5)
    rows = [(0, i, *map(float, rng.normal(size=3) / 4)) for i in range(150)] + [(1, i, 0.9 if i < 80 else 0.05, 0.1 * (i % 3), 0.0) for i in range(120)] + [(2, 7, 1.0, 1.0, 1.0)]
    asked = [*rows, (1, 900, 1.45, 0.0, 0.0), (1, 901, -0.44, 0.0, 0.0), (2, 902, 9.0, 9.0, 9.0), (3, 903, 0.0, 0.0, 0.0)]
    got = points.ball_query(cloud_of(spark, asked), cloud_of(spark, rows), 0.5, 4)
    got = sorted(tuple(r) for r in got.select("cloud", "p", "slot", "b_p").collect())
    want = []
    for c, p, *x in asked:
        hits = sorted(q for d, q, *y in rows if d == c and sum((a - b) * (a - b) for a, b in zip(x, y, strict=True)) <= 0.25)
        want += [(c, p, k, hits[k] if k < min(4, len(hits)) else hits[0]) for k in range(4) if hits]
    assert got == sorted(want)


def test_pairs_of_crowded_clouds_stay_few(spark, monkeypatch):
    """A crowd in a wide cloud: right by brute force, and far fewer pairs in the first round than on a grid by the cloud's extent."""
    seen = []
    rng = np.random.default_rng(6)
    rows = [(0, i, *map(float, rng.normal(size=3) / 100)) for i in range(400)] + [(0, 1000 + i, *map(float, 10 * rng.normal(size=3))) for i in range(20)]
    c = cloud_of(spark, rows)
    dealt = type(c).repartition
    monkeypatch.setattr(points, "MOST_PAIRS", 1)  # as many tasks as pairs, so that they are told
    monkeypatch.setattr(type(c), "repartition", lambda self, n, *by: seen.append(n) or dealt(self, 8, *by))
    got = sorted(tuple(r) for r in points.neighbours(c, c, 3).select("cloud", "p", "rank", "b_p").collect())
    want = []
    for _, p, *x in rows:
        near = sorted((sum((a - b) * (a - b) for a, b in zip(x, y, strict=True)), q) for _, q, *y in rows)
        want += [(0, p, k + 1, q) for k, (_, q) in enumerate(near[:3])]
    assert got == sorted(want)
    assert seen[0] < 420 * 420 / 4
