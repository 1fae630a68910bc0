"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions alone.

A text is cut into paragraph pieces, and each different piece has a 64-bit digest.
A sketch deals every digest to one cell in each of three tables; a cell holds a
count, the XOR of its digests and the XOR of their check values. The sketch of
one version less that of another holds the digests that differ; a cell with one
of them shows it, and taking it out of its other cells shows further ones. Every
fingerprint holds a small sketch of one size, and two are compared by taking one
from the other. When digests are left over, what the cells hold tells about how
many differ, and the pair is sketched again with as many cells as those ask for,
and twice as many each further time.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_or_empty

TABLES = 3
CELLS = 24  # of the stored fingerprint
ROUNDS = 9
ATTEMPTS = 10
SHORT_TEXT = 300
TINY_TEXT = 60
LONG_PIECE = 400
SLICE = 200
ENDS = r"\n+|(?<=[.!?|][^\w\s]{0,3})\s+"
CHECK_SEED = 77


# ------------------------------------------------------------------- pieces
def pieces(text: Column) -> Column:
    """Paragraphs, cut at the ends of their sentences; a long one without ends is cut into slices.

    A text of under SHORT_TEXT characters has too few sentences to tell likeness
    by, and gives its pairs of neighbouring words instead; one of under TINY_TEXT
    characters its runs of three characters. Up to twice these lengths a text
    gives both kinds, so that two versions on either side of a bound share one.
    """
    cutting = F.split(text, ENDS)
    slices = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / SLICE)), lambda i: F.substr(p, (i * SLICE + 1).cast("int"), F.lit(SLICE)))
    long_text = F.flatten(F.transform(cutting, lambda p: F.when(F.length(p) > LONG_PIECE, slices(p)).otherwise(F.array(p))))
    words = F.split(text, r"\s+")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.length(text) + 1), lambda w, after: F.concat_ws(" ", w, after))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: F.substr(text, i, F.lit(3)))
    n, none = F.length(text), F.array().cast("array<string>")
    kinds = ((n < 2 * TINY_TEXT, runs), ((n >= TINY_TEXT) & (n < 2 * SHORT_TEXT), pairs), (n >= SHORT_TEXT, long_text))
    return F.filter(F.concat(*[F.when(within, kind).otherwise(none) for within, kind in kinds]), lambda p: F.length(F.trim(p)) > 0)


def digests(text: Column) -> Column:
    """The different digests of a text's pieces."""
    return F.array_distinct(F.transform(pieces(text), lambda p: F.xxhash64(p)))


def check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(CHECK_SEED))


def position(d: Column, table: int, width: Column, seed: Column) -> Column:
    """The cell of a digest in one table, whose cells follow those of the tables before."""
    return F.pmod(F.xxhash64(d, F.lit(table), seed), width) + width * table


# --------------------------------------------------------------- comparison
STATE = ("n", "key", "chk")


def difference_cells(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Cells of the sketch of ``a`` less that of ``b``, for each row of ``pairs`` (by…, width, seed, a, b)."""
    plus = F.transform("a", lambda d: F.struct(F.lit(1).cast("long").alias("n"), d.alias("key")))
    minus = F.transform("b", lambda d: F.struct(F.lit(-1).cast("long").alias("n"), d.alias("key")))
    rows = pairs.select(*by, "width", "seed", F.explode(F.concat(plus, minus)).alias("e")).select(*by, "width", "seed", "e.n", "e.key")
    rows = rows.withColumn("chk", check(F.col("key")))
    spread = F.explode(F.array(*[position(F.col("key"), k, F.col("width"), F.col("seed")) for k in range(TABLES)]))
    return summed(rows.select(*by, "width", "seed", spread.alias("cell"), *STATE), by)


def summed(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = rows.groupBy(*by, "width", "seed", "cell").agg(F.sum("n").alias("n"), F.expr("bit_xor(key)").alias("key"), F.expr("bit_xor(chk)").alias("chk"))
    return sums.where("n != 0 or key != 0 or chk != 0")


ONLY_A, ONLY_B = -1, -2  # cells that gather what was recovered


def peel(cells: DataFrame, by: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` after ``rounds`` rounds of taking out digests that stand alone.

    Round r looks at table r mod 3, where a digest has one cell only, so none is
    taken out twice. What is recovered is counted in the cells ONLY_A and ONLY_B,
    which also hold the XOR of its digests. Rows of a pair never leave their task:
    every round groups by the pair's key and the cell.
    """
    for r in range(rounds):
        table = r % TABLES
        w, s, key = F.col("width"), F.col("seed"), F.col("key")
        alone = (F.floor(F.col("cell") / w) == table) & (F.abs("n") == 1) & (F.col("chk") == check(key)) & (position(key, table, w, s) == F.col("cell"))
        row = lambda cell, n, k, c: F.struct(cell.cast("long").alias("cell"), n.cast("long").alias("n"), k.alias("key"), c.alias("chk"))
        own = row(F.col("cell"), F.col("n"), key, F.col("chk"))
        others = [row(position(key, k, w, s), -F.col("n"), key, F.col("chk")) for k in range(TABLES) if k != table]
        gained = row(F.when(F.col("n") > 0, ONLY_A).otherwise(ONLY_B), F.lit(1), key, F.lit(0).cast("long"))
        out = F.when((F.col("cell") >= 0) & alone, F.array(gained, *others)).otherwise(F.array(own))
        cells = summed(cells.select(*by, "width", "seed", F.explode(out).alias("o")).select(*by, "width", "seed", "o.*"), by)
    return cells


def stored_cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cells of the sketch of the set ``a`` of each row, all of one size."""
    sized = rows.select(*by, "a", F.array().cast("array<bigint>").alias("b"), F.lit(CELLS // TABLES).cast("long").alias("width"), F.lit(0).alias("seed"))
    return difference_cells(sized, by)


def shown(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by…, cells): stored cells as a string, the empty ones left out."""
    packed = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cell", *STATE))).alias("cells"))
    said = F.transform("cells", lambda c: F.concat_ws(".", *[F.hex(c[x]) for x in ("cell", *STATE)]))
    return packed.select(*by, F.array_join(said, ",").alias("cells"))


def fingerprint(text_hash: Column, pieces_found: Column, cells: Column) -> Column:
    """A document's fingerprint: a digest of the text, the count of its pieces, its cells.

    Equal texts have equal fingerprints; the digest of the text tells apart texts
    that have the same pieces in another order.
    """
    return F.concat_ws(":", F.lit(f"iblt{CELLS}"), F.hex(text_hash), F.size(pieces_found).cast("string"), F.coalesce(cells, F.lit("")))


def subtracted(cells: DataFrame, home: str) -> DataFrame:
    """(home, side, width, seed, cell, state): the stored cells of side 0 less those of each other side of a ``home``."""
    others = F.array(*[F.struct(F.lit(s).alias("to"), F.lit(1).alias("sign")) for s in (1, 2)])
    to = F.when(F.col("side") == 0, others).otherwise(F.array(F.struct(F.col("side").alias("to"), F.lit(-1).alias("sign"))))
    rows = cells.select(home, "width", "seed", "cell", *STATE, F.explode(to).alias("t"))
    return summed(rows.select(home, F.col("t.to").alias("side"), "width", "seed", "cell", (F.col("n") * F.col("t.sign")).alias("n"), "key", "chk"), [home, "side"])


def width_for(about: Column, n_a: Column, n_b: Column, attempt: int) -> Column:
    """Cells of each table for about as many differences, which the sets' sizes bound; twice as many with each attempt."""
    within = F.least(F.greatest(about, F.abs(n_a - n_b)), n_a + n_b)
    return F.ceil(within * (0.7 * 2 ** (attempt - 1)) + 3).cast("long")


def compare(sets: DataFrame, cells: DataFrame, home: str) -> DataFrame:
    """(home, side, only_a, only_b): how many digests of ``a`` aren't in another set of the row, and the reverse.

    ``sets`` (home, a, b1, b2) gives the pairs of sides 1 and 2, and ``cells`` the
    differences of their stored sketches. Pairs whose sketch holds more than peeling
    recovers are sketched again, larger and with other hashes; for one that is still
    not peeled after ATTEMPTS, the sets themselves are compared. Null arrays are
    empty. A home is unique. Pairs without a difference leave no cell, and have no
    row. Only counts are exchanged.
    """
    by, empty = [home, "side"], F.array().cast("array<bigint>")
    rest = sets.select(home, *[F.coalesce(c, empty).alias(c) for c in ("a", "b1", "b2")])
    done = None
    for attempt in range(ATTEMPTS):
        peeled = peel(cells, by, ROUNDS + TABLES * min(attempt, 4))
        inside, n = F.col("cell") >= 0, F.col("n").cast("double")
        counts = peeled.groupBy(*by).agg(
            F.sum(F.when(F.col("cell") == ONLY_A, F.col("n")).otherwise(0)).alias("only_a"),
            F.sum(F.when(F.col("cell") == ONLY_B, F.col("n")).otherwise(0)).alias("only_b"),
            F.sum(F.when(inside, 1).otherwise(0)).alias("left"),
            # digests of both signs fall on cells at random: the squares of the counts tell how many there are
            F.sum(F.when(inside, n * n).otherwise(0.0)).alias("squares"),
            F.sum(F.when(inside, n).otherwise(0.0)).alias("sum"),
            F.max("width").alias("width"),
        )
        surplus = F.col("sum") / TABLES
        about = F.col("only_a") + F.col("only_b") + F.greatest(F.lit(1.0), (F.col("squares") / TABLES - surplus * surplus / F.col("width")) / (1 - 1 / F.col("width")))
        # what is kept is no wider than it must be: about how many differ, where peeling left cells
        counts = cut(counts.select(*by, "only_a", "only_b", F.when(F.col("left") > 0, about).alias("about")))
        good = counts.where("about is null").drop("about")
        done = good if done is None else done.unionAll(good)
        failed = counts.where("about is not null")
        if failed.isEmpty():
            return done
        failed = failed.groupBy(home).agg(*[F.max(F.when(F.col("side") == s, F.col("about"))).alias(f"_about{s}") for s in (1, 2)])
        sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"_about{s}").alias("about"), F.col(f"b{s}").alias("b")) for s in (1, 2)])
        again = rest.join(failed, home).select(home, "a", F.explode(F.filter(sides, lambda x: x["about"].isNotNull())).alias("s")).select(home, "a", "s.*")
        n_a, n_b = F.size("a"), F.size("b")
        if attempt < ATTEMPTS - 1:
            cells = difference_cells(again.withColumn("width", width_for(F.col("about"), n_a, n_b, attempt + 1)).withColumn("seed", F.lit(attempt + 1)), by)
    exact = again.select(*by, F.size(F.array_except("a", "b")).cast("long").alias("only_a"), F.size(F.array_except("b", "a")).cast("long").alias("only_b"))
    return done.unionAll(exact)


def likeness(n_a: Column, n_b: Column, only_a: Column, only_b: Column) -> Column:
    """Shared digests among all digests of two sets, from what differs; two empty sets are alike."""
    shared = ((n_a - only_a) + (n_b - only_b)) / 2
    every = shared + only_a + only_b
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


# ------------------------------------------------------------------ versions
PARTS = ("kept", "gone", "come_next", "come", "rest_next")


def in_parts(rows: DataFrame) -> DataFrame:
    """``rows`` with PARTS in place of own_set, edited_set and next_set, which share most of their digests: what two of them hold is kept once."""
    rows = rows.withColumn("kept", F.array_intersect("own_set", "edited_set")).withColumn("gone", F.array_except("own_set", "kept"))
    rows = rows.withColumn("new", F.array_except("edited_set", "kept")).withColumn("come_next", F.array_intersect("new", "next_set"))
    rows = rows.withColumn("come", F.array_except("new", "come_next")).withColumn("rest_next", F.array_except("next_set", "come_next"))
    return rows.drop("own_set", "edited_set", "next_set", "new")


def whole_sets() -> tuple[Column, Column, Column]:
    """A document's own set, its edited version's and the next document's, from PARTS."""
    return F.concat("kept", "gone"), F.concat("kept", "come_next", "come"), F.concat("come_next", "rest_next")


def followers(docs: DataFrame) -> DataFrame:
    """(doc_id, half, next_id): each document's half length and the next id; the last is followed by the first."""
    rows = docs.groupBy("doc_id").agg(F.min(F.length("text")).alias("chars")).select("doc_id", F.floor(F.col("chars") / 2).cast("int").alias("half"))
    placed = cut(rows.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    bounds = placed.groupBy("part").agg(F.min("doc_id").alias("first"))
    # one row per partition
    whole = W.orderBy("part")
    after = bounds.withColumn("after", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))).select("part", "after")
    linked = placed.withColumn("lead", F.lead("doc_id").over(W.partitionBy("part").orderBy("doc_id")))
    return linked.join(after, "part").select("doc_id", "half", F.coalesce("lead", "after").alias("next_id"))


def version_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text), of each document's edited version, and their likenesses.

    The edited version has the last half of the text, rounded down, replaced by as
    many signs of the next document in ascending ``doc_id`` order, or by all of it.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. Null texts are empty; an empty text has no pieces,
    and is like another empty one. Rows without a ``doc_id`` are left out, and of
    rows that repeat one, that with the shortest text, the smallest of equals, counts. An empty table gives
    no rows. Other columns are not read.

    Texts are exchanged once by id, and of each the part that the document before
    needs once more. The digests stay where the exchange has put them, on disk: to
    read them from a checkpoint would exchange them, and all cells, again. What
    the sets of a row share is kept once. Lost ones are made again from the texts.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_or_empty().alias("text"))
    # twice as many parts as usual: the cells of a part's pairs are several times its texts
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unique = rows.repartition(parts, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.length("text"), "text")).alias("least")).select("doc_id", F.col("least.text").alias("text"))
    edges = followers(rows)
    told = unique.join(edges.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to"), "half"), "doc_id")
    told = told.select(F.col("to").alias("doc_id"), "half", F.substr("text", F.lit(1), F.col("half")).alias("instead"), digests(F.col("text")).alias("next_set")).repartition(parts, "doc_id")
    both = unique.join(told, "doc_id")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("half")), F.col("instead"))
    both = both.withColumn("edited", edited).select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", "edited", digests(F.col("text")).alias("own_set"), digests(F.col("edited")).alias("edited_set"), "next_set")
    marks = both.select("doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), F.xxhash64("text").alias("own_hash"), F.xxhash64("edited").alias("edited_hash"), "own_set", "edited_set", "next_set")
    marks = in_parts(marks).persist(StorageLevel.DISK_ONLY)
    own, edited, following = whole_sets()
    sets = F.array(*[F.struct(F.lit(k).alias("side"), c.alias("a")) for k, c in enumerate((own, edited, following))])
    cells = stored_cells(marks.select("doc_id", F.explode(sets).alias("s")).select("doc_id", "s.side", "s.a"), ["doc_id", "side"])
    sets = marks.select("doc_id", own.alias("a"), edited.alias("b1"), following.alias("b2"))
    counts = compare(sets, subtracted(cells, "doc_id"), "doc_id")
    gone = lambda side, name: F.sum(F.when(F.col("side") == side, F.col(name)).otherwise(0))
    wide = counts.groupBy("doc_id").agg(*[gone(s, n).alias(f"{n}_{s}") for s in (1, 2) for n in ("only_a", "only_b")])
    cells = shown(cells.where("side < 2"), ["doc_id", "side"])
    cells = cells.groupBy("doc_id").agg(*[F.max(F.when(F.col("side") == s, F.col("cells"))).alias(f"cells_{s}") for s in (0, 1)])
    out = marks.join(wide, "doc_id", "left").join(cells, "doc_id", "left")
    # concatenated arrays hold no digest twice, so their sizes are the sets'
    n, zero = lambda c: F.size(c).cast("long"), lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        fingerprint(F.col("own_hash"), own, F.col("cells_0")).alias("fingerprint"),
        fingerprint(F.col("edited_hash"), edited, F.col("cells_1")).alias("edited_fingerprint"),
        likeness(n(own), n(edited), zero("only_a_1"), zero("only_b_1")).alias("near_edited"),
        likeness(n(own), n(following), zero("only_a_2"), zero("only_b_2")).alias("near_next"),
    )
