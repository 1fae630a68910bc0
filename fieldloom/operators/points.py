"""Point clouds (cloud, p, x, y, z): neighbours, balls, distances between clouds, normalisation, sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept, sent_whole
from .entropy import prefix_sums

AXES = ("x", "y", "z")
MOST_CLOUDS = 200_000
MOST_PAIRS = 1 << 20  # compared by one task, on the mean
MOST_FINER = 8  # times that a grid is made finer before the first look


def squared_distance(a: str = "", b: str = "b_") -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def others(points: DataFrame) -> DataFrame:
    return points.select("cloud", *[F.col(c).alias(f"b_{c}") for c in ("p", *AXES)])


def neighbours(queries: DataFrame, points: DataFrame, k: int, self_too: bool = True) -> DataFrame:
    """(cloud, p, b_p, d2, rank): the k nearest points of the same cloud, ties by point number.

    Points are filed by grid cell, some k of them in the cell of most points, and a
    query looks into the 27 cells around its own: an equi-join, in as many tasks as
    its counted pairs ask for. It is done once its k-th neighbour is nearer than
    the edge of these cells; the others look again on a grid twice as wide, until a
    cell is as wide as the cloud. Only points around what is open are read again.
    All pairs of a query meet in one task, and k of them leave it. Of points
    at one place only the k + 1 first can be neighbours, so a crowded place is no
    crowded join. A query in a cloud of fewer points finds them all.
    """
    here = W.partitionBy("cloud", *AXES).orderBy("p")
    apart = kept(points.select("cloud", "p", *AXES).withColumn("_here", F.row_number().over(here)).where(F.col("_here") <= k + 1).drop("_here"))
    spans = [F.min(c).alias(f"_l{c}") for c in AXES]
    extent = F.greatest(*[F.max(c) - F.min(c) for c in AXES])
    boxes = apart.groupBy("cloud").agg(*spans, extent.alias("_extent"), F.count("*").alias("_n"))
    width = F.when(F.col("_extent") > 0, F.col("_extent") * F.least(F.lit(1.0), F.pow(F.lit(float(k)) / F.col("_n"), F.lit(1 / 3)))).otherwise(1.0)
    boxes = sent_whole(kept(boxes.withColumn("_w", width)), MOST_CLOUDS)
    # a finer grid where points crowd: how many share a point's cell, on the mean, tells by how much
    axes = [f"g{c}" for c in AXES]
    for _ in range(MOST_FINER):
        cells = apart.join(boxes.drop("_n"), "cloud").groupBy("cloud", *[F.floor((F.col(c) - F.col(f"_l{c}")) / F.col("_w")).alias(g) for c, g in zip(AXES, axes, strict=True)]).count()
        crowds = kept(cells.groupBy("cloud").agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("_crowd")))
        if crowds.where(F.col("_crowd") > 4 * k).isEmpty():
            break
        finer = F.least(F.lit(1.0), F.pow(F.lit(float(k)) / F.col("_crowd"), F.lit(1 / 3)))
        boxes = sent_whole(kept(boxes.join(crowds, "cloud", "left").withColumn("_w", F.col("_w") * F.coalesce(finer, F.lit(1.0))).drop("_crowd")), MOST_CLOUDS)
    filed = others(apart).join(boxes.drop("_n"), "cloud")
    open_ = queries.select("cloud", "p", *AXES).join(boxes.drop("_n"), "cloud")
    done, grow = None, 1.0
    while True:
        at = lambda c, prefix: F.floor((F.col(f"{prefix}{c}") - F.col(f"_l{c}")) / (F.col("_w") * grow))  # noqa: E731, B023
        grid = filed.withColumns({f"g{c}": at(c, "b_") for c in AXES}).drop("_w", "_extent", *[f"_l{c}" for c in AXES])
        asked, edge = open_, F.lit(float("inf"))
        for c in AXES:
            own = at(c, "")
            low, wide = F.col(f"_l{c}"), F.col("_w") * grow
            edge = F.least(edge, F.col(c) - (low + (own - 1) * wide), low + (own + 2) * wide - F.col(c))
        # a grid as wide as the cloud holds all points around a query that lies within it; one outside looks on until it does
        everything = F.lit(True)
        for c in AXES:
            everything = everything & (at(c, "") - 1 <= 0) & (at(c, "") + 1 >= F.floor(F.col("_extent") / (F.col("_w") * grow)))
        asked = asked.withColumn("_edge", F.when(everything, float("inf")).otherwise(edge))
        asked = asked.withColumns({g: at(c, "") for c, g in zip(AXES, axes, strict=True)})
        around = spread(asked.groupBy("cloud", *axes).agg(F.count("*").alias("_asked")), axes).groupBy("cloud", *axes).agg(F.sum("_asked").alias("_asked"))
        around = kept(around.join(grid.groupBy("cloud", *axes).agg(F.count("*").alias("_held")), ["cloud", *axes]))
        pairs = around.agg(F.sum(F.col("_asked") * F.col("_held"))).first()[0] or 0
        close = spread(grid.join(around.select("cloud", *axes), ["cloud", *axes], "left_semi"), axes)
        dealt = lambda rows: rows.repartition(1 + pairs // MOST_PAIRS, "cloud", *axes)  # noqa: E731, B023
        met = dealt(asked).join(dealt(close), ["cloud", *axes]).withColumn("d2", squared_distance())
        met = met if self_too else met.where("p != b_p")
        ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("cloud", "p").orderBy("d2", "b_p"))).where(F.col("rank") <= k)
        ranked = kept(ranked.select("cloud", "p", "b_p", "d2", "rank", "_edge"))
        enough = ranked.groupBy("cloud", "p").agg(F.count("*").alias("_n"), F.max("d2").alias("_far"), F.max("_edge").alias("_edge"))
        enough = enough.where((F.col("_edge") == float("inf")) | (F.col("_n") == k) & (F.sqrt("_far") < F.col("_edge"))).select("cloud", "p")
        found = ranked.join(enough, ["cloud", "p"], "left_semi").drop("_edge")
        done = found if done is None else done.unionAll(found)
        # a query that everything is around is done, even where nothing is
        open_ = kept(open_.join(enough, ["cloud", "p"], "left_anti").where(~everything))
        if open_.isEmpty():
            return done
        grow *= 2


def cell(c: str, radius: float) -> Column:
    return F.floor(F.col(c) / (radius * (1 + 1e-9)))  # so that rounding parts no pair by two cells


FIRST_HELD = 16  # points of a cell that its neighbourhood is given in the first round of a ball query


def ball_query(queries: DataFrame, points: DataFrame, radius: float, most: int) -> DataFrame:
    """(cloud, p, slot, b_p): the first ``most`` points within ``radius`` by number, short lists filled with the first.

    Points are filed by grid cell as wide as the radius, and a query looks into
    the 27 cells around its own, at their first points by number only: lists of
    these are gathered once for a cell, not for a query. A query is done once it
    has ``most`` hits before the first point that it wasn't given. The few others
    look at the next points of these cells, eight times as many each round, by an
    equi-join; so pairs grow with the queries, not with their square.
    """
    axes = [f"g{c}" for c in AXES]
    filed = others(points).withColumns({f"g{c}": cell(f"b_{c}", radius) for c in AXES})
    filed = kept(filed.withColumn("_place", F.row_number().over(W.partitionBy("cloud", *axes).orderBy("b_p"))))
    near = lambda rows: spread(rows, axes)
    d2 = lambda x: sum(((F.col(c) - x[f"b_{c}"]) * (F.col(c) - x[f"b_{c}"]) for c in AXES[1:]), (F.col("x") - x["b_x"]) * (F.col("x") - x["b_x"]))

    held = max(FIRST_HELD, most)
    given = F.collect_list(F.when(F.col("_place") <= held, F.struct("b_p", *[f"b_{c}" for c in AXES])))
    ahead = F.min(F.when(F.col("_place") > held, F.col("b_p")))
    around = near(filed.where(F.col("_place") <= held + 1)).groupBy("cloud", *axes).agg(F.sort_array(given).alias("_given"), ahead.alias("_ahead"))
    asked = queries.select("cloud", "p", *AXES, *[cell(c, radius).alias(g) for c, g in zip(AXES, axes, strict=True)])
    hits = F.slice(F.transform(F.filter("_given", lambda x: d2(x) <= radius * radius), lambda x: x["b_p"]), 1, most)
    looked = kept(asked.join(around, ["cloud", *axes]).select("cloud", "p", *AXES, *axes, hits.alias("hits"), "_ahead"))
    done = F.col("_ahead").isNull() | F.coalesce(F.get("hits", F.lit(most - 1)) < F.col("_ahead"), F.lit(False))
    found, open_ = looked.where(done).select("cloud", "p", "hits"), looked.where(~done)
    while not open_.isEmpty():
        last, held = held, 8 * held
        block = filed.where((F.col("_place") > last) & (F.col("_place") <= held))
        ahead = near(filed.where(F.col("_place") == held + 1)).groupBy("cloud", *axes).agg(F.min("b_p").alias("_next"))
        met = near(open_.select("cloud", "p", *AXES, *axes)).join(block, ["cloud", *axes]).where(squared_distance() <= radius * radius)
        first = met.withColumn("_n", F.row_number().over(W.partitionBy("cloud", "p").orderBy("b_p"))).where(F.col("_n") <= most)
        more = first.groupBy("cloud", "p").agg(F.collect_list("b_p").alias("_more"))
        both = open_.drop("_ahead").join(more, ["cloud", "p"], "left").join(ahead.withColumnRenamed("_next", "_ahead"), ["cloud", *axes], "left")
        merged = F.slice(F.sort_array(F.concat("hits", F.coalesce("_more", F.slice("hits", 1, 0)))), 1, most)
        looked = kept(both.select("cloud", "p", *AXES, *axes, merged.alias("hits"), "_ahead"))
        found, open_ = found.unionAll(looked.where(done).select("cloud", "p", "hits")), looked.where(~done)
    slots = found.where(F.size("hits") > 0).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    return slots.select("cloud", "p", F.col("slot").cast("long").alias("slot"), F.coalesce(F.get("hits", F.col("slot")), F.get("hits", F.lit(0))).alias("b_p"))


def spread(rows: DataFrame, axes: list[str]) -> DataFrame:
    """``rows`` once in each of the 27 cells around their own."""
    for g in axes:
        rows = rows.withColumn(g, F.explode(F.array(*[F.col(g) + i for i in (-1, 0, 1)])))
    return rows


def chamfer(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cloud, chamfer): mean squared distance to the nearest point, both ways, summed."""
    there = neighbours(a, b, 1).groupBy("cloud").agg(F.avg("d2").alias("there"))
    back = neighbours(b, a, 1).groupBy("cloud").agg(F.avg("d2").alias("back"))
    return there.join(back, "cloud").select("cloud", (F.col("there") + F.col("back")).alias("chamfer"))


def collapsed_sets(coarse: DataFrame, fine: DataFrame, k: int) -> DataFrame:
    """(cloud, p, size, distance): of each coarse point, the fine points among its k nearest that are nearest to it, and their mean distance."""
    mine = neighbours(coarse, fine, k).select("cloud", "p", F.col("b_p").alias("f"), "d2")
    owner = neighbours(fine, coarse, 1).select("cloud", F.col("p").alias("f"), F.col("b_p").alias("p"))
    return mine.join(owner, ["cloud", "p", "f"]).groupBy("cloud", "p").agg(F.count("*").alias("size"), F.avg(F.sqrt("d2")).alias("distance"))


def interpolated(queries: DataFrame, points: DataFrame, value: str, k: int = 3, eps: float = 1e-8) -> DataFrame:
    """(cloud, p, value): the k nearest points' values, weighted by inverse squared distance."""
    weight = 1 / (F.col("d2") + eps)
    near = neighbours(queries, points, k).join(points.select("cloud", F.col("p").alias("b_p"), value), ["cloud", "b_p"])
    return near.groupBy("cloud", "p").agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("value"))


def unit_clouds(points: DataFrame) -> DataFrame:
    """``points`` moved to their centroid and scaled to a largest norm of 1."""
    centre = points.groupBy("cloud").agg(*[F.avg(c).alias(f"m_{c}") for c in AXES])
    moved = points.join(centre, "cloud").withColumns({c: F.col(c) - F.col(f"m_{c}") for c in AXES}).drop(*[f"m_{c}" for c in AXES])
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in AXES), F.lit(0.0)))
    largest = moved.groupBy("cloud").agg(F.max(norm).alias("largest"))
    return moved.join(largest, "cloud").withColumns({c: F.try_divide(F.col(c), F.col("largest")) for c in AXES}).drop("largest")


def farthest_points(points: DataFrame, m: int) -> DataFrame:
    """(cloud, pick, p): m points of each cloud, each the farthest from those before; the first is that with the smallest number.

    One pick of every cloud at a time: distances are kept with the points, wherever
    these lie, and only the farthest point of each task is exchanged. Of equally
    far points the one with the smallest number is picked; a cloud of fewer points
    gives them all.
    """
    rows = kept(points.select("cloud", "p", *AXES).withColumn("_least", F.lit(float("inf"))))
    out = None
    first = F.max_by(F.struct("p", *AXES), F.struct("_least", -F.col("p")))
    for pick in range(m):
        chosen = kept(rows.where("_least > 0").groupBy("cloud").agg(first.alias("b")).select("cloud", F.lit(pick).alias("pick"), *[F.col(f"b.{c}").alias(f"b_{c}") for c in ("p", *AXES)]))
        out = chosen if out is None else out.unionAll(chosen)
        if pick < m - 1:
            # the point itself is 0 from now on, and so is what lies at its place
            near = rows.join(sent_whole(chosen.drop("pick"), MOST_CLOUDS), "cloud")
            rows = kept(near.select("cloud", "p", *AXES, F.least("_least", squared_distance()).alias("_least")))
    return out.select("cloud", "pick", F.col("b_p").alias("p"))


def rotated(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    return points.withColumns({c: sum((F.col(a) * float(m) for a, m in zip(AXES, row, strict=True)), F.lit(0.0)) for c, row in zip(AXES, matrix, strict=True)})


def random_rotation(seed: int) -> list[list[float]]:
    """A rotation drawn evenly: the orthogonal factor of a normal matrix, signs fixed, determinant 1."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return q.tolist()


def sphere_mesh(spark: SparkSession, level: int) -> DataFrame:
    """(face, corner, x, y, z): an icosahedron on the unit sphere whose faces are cut in four ``level`` times.

    Each cut is one row to four, so a fine mesh is made where its faces lie.
    """
    g = (1 + 5**0.5) / 2
    v = np.array([(a, b * g, 0) for a in (-1, 1) for b in (-1, 1)] + [(0, a, b * g) for a in (-1, 1) for b in (-1, 1)] + [(a * g, 0, b) for a in (-1, 1) for b in (-1, 1)], dtype=float)
    v /= np.linalg.norm(v[0])
    edge = min(np.linalg.norm(v[0] - u) for u in v[1:])
    near = lambda i, j: abs(np.linalg.norm(v[i] - v[j]) - edge) < 1e-9
    corners = [(i, j, k) for i in range(12) for j in range(i + 1, 12) for k in range(j + 1, 12) if near(i, j) and near(j, k) and near(i, k)]
    faces = spark.createDataFrame([(n, *[v[c].tolist() for c in f]) for n, f in enumerate(corners)], "face long, a array<double>, b array<double>, c array<double>")

    def middle(p: str, q: str) -> Column:
        added = F.zip_with(p, q, lambda x, y: x + y)
        norm = F.sqrt(F.aggregate(added, F.lit(0.0), lambda t, x: t + x * x))
        return F.transform(added, lambda x: x / norm)

    for _ in range(level):
        faces = faces.withColumns({"ab": middle("a", "b"), "bc": middle("b", "c"), "ca": middle("c", "a")})
        cut = F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(s).alias(d) for s, d in zip(t, "abc", strict=True)]) for i, t in enumerate((("a", "ab", "ca"), ("ab", "b", "bc"), ("ca", "bc", "c"), ("ab", "bc", "ca")))])
        faces = faces.select("face", F.explode(cut).alias("t")).select((F.col("face") * 4 + F.col("t.i")).alias("face"), "t.a", "t.b", "t.c")
    return faces.select("face", F.posexplode(F.array("a", "b", "c")).alias("corner", "v")).select("face", "corner", *[F.col("v")[i].alias(c) for i, c in enumerate(AXES)])


def surface_points(faces: DataFrame, m: int, seed: int = 1) -> DataFrame:
    """(mesh, i, face, x, y, z): ``m`` points of each mesh, as many on a face as its area asks for, drawn by a keyed hash.

    ``faces`` (mesh, face, a, b, c: arrays of three). Areas are summed up by mesh,
    a draw falls on the face whose running sum it hits, and two further numbers,
    folded into the triangle, place it there.
    """
    less = lambda p, q: F.zip_with(p, q, lambda x, y: x - y)
    sized = faces.withColumn("_u", less("b", "a")).withColumn("_v", less("c", "a"))
    cross = [F.col("_u")[i] * F.col("_v")[j] - F.col("_u")[j] * F.col("_v")[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    sized = sized.withColumn("_area", F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2)
    run = prefix_sums(sized, "mesh", "face", "_area", width=4096)
    totals = kept(sized.groupBy("mesh").agg(F.sum("_area").alias("_total")))
    unit = lambda what: (F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "mesh", "i"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    draws = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("_at", unit("face") * F.col("_total"))
    step = F.col("_total") / 64
    filed = run.join(sent_whole(totals, MOST_CLOUDS), "mesh").withColumn("_part", F.explode(F.sequence(F.floor(F.col("before") / step), F.floor(F.col("through") / step))))
    hit = draws.withColumn("_part", F.floor(F.col("_at") / step)).join(filed.drop("_total"), ["mesh", "_part"]).where("_at >= before and _at < through")
    s, t = unit("s"), unit("t")
    fold = s + t > 1
    hit = hit.withColumn("_s", F.when(fold, 1 - s).otherwise(s)).withColumn("_t", F.when(fold, 1 - t).otherwise(t))
    return hit.select("mesh", "i", "face", *[(F.col("a")[k] + F.col("_s") * F.col("_u")[k] + F.col("_t") * F.col("_v")[k]).alias(c) for k, c in enumerate(AXES)])


def strongest(points: DataFrame, near: DataFrame, values: list[str]) -> DataFrame:
    """(cloud, p, values…): of each query in ``near`` (cloud, p, b_p) the largest of each value over its neighbours."""
    told = near.join(points.select("cloud", F.col("p").alias("b_p"), *values), ["cloud", "b_p"])
    return told.groupBy("cloud", "p").agg(*[F.max(c).alias(c) for c in values])


def cloud_losses(a: DataFrame, b: DataFrame, wanted: int) -> DataFrame:
    """(cloud, density, count, normals, latent) of points (cloud, p, d, nx, ny, nz, y) against reference points of the same numbers: mean absolute difference of densities, how far the count is from ``wanted``, mean squared differences of normals and of latents."""
    both = a.alias("a").join(b.alias("b"), ["cloud", "p"])
    gap = lambda c: F.col(f"a.{c}") - F.col(f"b.{c}")
    normals = sum((gap(c) * gap(c) for c in ("nx", "ny", "nz")), F.lit(0.0)) / 3
    return both.groupBy("cloud").agg(F.avg(F.abs(gap("d"))).alias("density"), F.abs(F.count("*") - wanted).alias("count"), F.avg(normals).alias("normals"), F.avg(gap("y") * gap("y")).alias("latent"))
