"""The same queries as ``relational``, in DuckDB's SQL."""

from __future__ import annotations

from ..operators.entropy import scale_table
from .science import FIELD

HIST = """hist AS (SELECT l_returnflag AS stream, l_quantity::BIGINT AS sym, count(*) AS cells FROM lineitem GROUP BY 1, 2), total AS (SELECT stream, sum(cells)::BIGINT AS total FROM hist GROUP BY 1)"""
CDF = f"""{HIST}, freq AS (SELECT stream, sym, cells, row_number() OVER (PARTITION BY stream ORDER BY sym) AS k, count(*) OVER (PARTITION BY stream) AS m,
  sum(greatest(1, round(cells * (65535.0::DOUBLE / total))::BIGINT)) OVER (PARTITION BY stream ORDER BY sym) AS up FROM hist JOIN total USING (stream)),
 forced AS (SELECT *, CASE WHEN k = m THEN 65536 ELSE up END AS f FROM freq),
 high AS (SELECT stream, sym, cells, (min(f - k) OVER (PARTITION BY stream ORDER BY sym DESC) + k)::BIGINT AS hi FROM forced),
 cdf AS (SELECT stream, sym, cells, coalesce(lag(hi) OVER (PARTITION BY stream ORDER BY sym), 0)::BIGINT AS lo, hi FROM high)"""
SYM = f"{FIELD}, cells AS (SELECT *, round_even(v * 8, 0)::BIGINT AS sym FROM field)"
CLOUD = "cloud AS (SELECT label AS cloud, vec_id AS p, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
SWEEP = f"""{FIELD}, sweep AS (SELECT label, q::INTEGER AS q, sqrt(avg((v - round_even(v * q, 0) / q) * (v - round_even(v * q, 0) / q))) AS rmse, sum(log2(1 + abs(round_even(v * q, 0)))) AS bits
  FROM field, (SELECT unnest(range(1, 9)) AS q) s GROUP BY label, q)"""


def nearest(a: str, b: str, k: int) -> str:
    """The k nearest of the rows ``b`` to each of ``a``, as a query."""
    return f"(SELECT * FROM (SELECT a.cloud, a.p, b.p AS b_p, {D2} AS d2, row_number() OVER (PARTITION BY a.cloud, a.p ORDER BY {D2}, b.p) AS rank FROM (SELECT * FROM cloud WHERE {a}) a JOIN (SELECT * FROM cloud WHERE {b}) b USING (cloud)) WHERE rank <= {k})"


def erfc(x: str) -> str:
    """The fit of the complementary error function, for x of at least 0."""
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x})))"
    fit = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-({x}) * ({x}))"
    return f"CASE WHEN {x} >= 0 THEN {fit} ELSE 2 - {fit} END"


def likelihood(x: str, mean: float, scale: float) -> str:
    root = "1.4142135623730951::DOUBLE"
    cdf = lambda end: f"0.5 * ({erfc(f'(-(({end} - abs({x} - {mean})) / {scale}::DOUBLE) / {root})')})"
    return f"greatest({cdf('0.5')} - ({cdf('-0.5')}), 1e-9)"


SCALES = ", ".join(f"{s!r}::DOUBLE" for s in scale_table()[:-1])
EVENTS = "SELECT user_id, event_id, ts, value, event_type FROM events"
HEADER = "lpad(hex(p_partkey % 256), 2, '0') || lpad(hex((p_partkey % 3) * 16 + p_size % 8), 2, '0')"
U32 = "lpad(hex({}::BIGINT), 8, '0')"

ORACLES = {
    "symbol_histogram": f"WITH {HIST} SELECT stream, sym, cells, total, round(cells / total, 9) AS p FROM hist JOIN total USING (stream)",
    "symbol_entropy": f"WITH {HIST} SELECT stream, total, round(sum(cells * -log2(cells / total)), 4) AS bits, round(sum(cells * -log2(cells / total)) / total, 4) AS bits_per_symbol FROM hist JOIN total USING (stream) GROUP BY stream, total",
    "smoothed_cdf": f"WITH {CDF} SELECT stream, sym, lo, hi FROM cdf",
    "cdf_prefix": f"WITH {HIST} SELECT stream, sym, (sum(cells) OVER w - cells)::BIGINT AS \"before\", (sum(cells) OVER w)::BIGINT AS through FROM hist WINDOW w AS (PARTITION BY stream ORDER BY sym)",
    "pmf_from_cdf": f"WITH {CDF} SELECT stream, sym, hi - lo AS step FROM cdf",
    "bit_cost": f"WITH {CDF} SELECT stream, round(sum(cells * -log2((hi - lo) / 65536.0)), 4) AS bits, sum(cells)::BIGINT AS total FROM cdf GROUP BY stream",
    "context_entropy": f"""WITH {SYM}, m AS (SELECT arg_max(sym, n * 1000 - sym) AS mode FROM (SELECT sym, count(*) AS n FROM cells GROUP BY sym)),
      c AS (SELECT sym, (coalesce(abs(lag(sym) OVER (PARTITION BY n, w ORDER BY h) - mode) > 1, false)::INTEGER + coalesce(abs(lag(sym) OVER (PARTITION BY n, h ORDER BY w) - mode) > 1, false)::INTEGER) AS ctx FROM cells, m),
      g AS (SELECT ctx, sym, count(*) AS cells FROM c GROUP BY ALL), t AS (SELECT ctx, sum(cells)::BIGINT AS total FROM g GROUP BY ctx)
      SELECT ctx, total, round(sum(cells * -log2(cells / total)), 4) AS bits, round(sum(cells * -log2(cells / total)) / total, 4) AS bits_per_symbol FROM g JOIN t USING (ctx) GROUP BY ctx, total""",
    "zero_slices": f"WITH {FIELD} SELECT n, sum(abs(round_even(v * 2, 0)))::BIGINT AS mass FROM field GROUP BY n HAVING mass > 0",
    "channel_activity": f"""WITH {SYM}, k AS (SELECT *, h * 8 + w AS c FROM cells), m AS (SELECT c, arg_max(sym, n * 1000 - sym) AS mode FROM (SELECT c, sym, count(*) AS n FROM k GROUP BY ALL) GROUP BY c),
      a AS (SELECT c, label, bool_or(sym <> mode) AS active FROM k JOIN m USING (c) GROUP BY ALL) SELECT c, greatest(1, least(round_even(avg(active::INTEGER) * 65536, 0), 65535))::BIGINT AS activity FROM a GROUP BY c""",
    "scale_bucket": f"WITH {FIELD}, s AS (SELECT n, stddev_pop(v) * 4 AS scale FROM field GROUP BY n) SELECT n, round(scale, 6) AS scale, len(list_filter([{SCALES}], lambda t: t < greatest(scale, 0.11::DOUBLE)))::BIGINT AS bucket FROM s",
    "escape_bits": "WITH s AS (SELECT l_quantity::BIGINT - 10 AS sym FROM lineitem), r AS (SELECT sym, CASE WHEN sym < 0 THEN -2 * sym - 1 WHEN sym >= 16 THEN 2 * (sym - 16) END AS raw FROM s), g AS (SELECT sym, raw, CASE WHEN raw = 0 THEN 0 ELSE ceil((floor(log2(raw)) + 1) / 4) END AS groups FROM r) SELECT sym, (CASE WHEN raw IS NULL THEN 0 ELSE 4 * groups + 4 * (floor(groups / 15) + 1) END)::BIGINT AS bits, count(*) AS cells FROM g GROUP BY ALL",
    "normal_likelihood": f"WITH {FIELD} SELECT n, round(sum(-log2({likelihood('round_even(v * 8, 0)', 0.0, 2.0)})), 6) AS bits FROM field GROUP BY n",
    "mixture_likelihood": f"WITH {FIELD} SELECT n, round(sum(-log2(0.25 * {likelihood('round_even(v * 8, 0)', -1.0, 1.0)} + 0.75 * {likelihood('round_even(v * 8, 0)', 1.0, 3.0)})), 6) AS bits FROM field GROUP BY n",
    "cdf_lookup": f"WITH {CDF} SELECT l_orderkey, l_linenumber, lo, hi FROM lineitem JOIN cdf ON stream = l_returnflag AND sym = l_quantity::BIGINT",
    "symbol_range_join": f"WITH {CDF}, q AS (SELECT l_orderkey, l_linenumber, l_returnflag AS stream, (l_orderkey * 40503 + l_linenumber * 977) % 65536 AS cf FROM lineitem) SELECT l_orderkey, l_linenumber, cf, sym FROM q JOIN cdf ON q.stream = cdf.stream AND cf >= lo AND cf < hi",
    "chunk_offsets": "WITH s AS (SELECT source, doc_id, octet_length(encode(text))::BIGINT AS size FROM documents) SELECT source, doc_id, size, (sum(size) OVER (PARTITION BY source ORDER BY doc_id) - size)::BIGINT AS \"offset\" FROM s",
    "side_file_join": "SELECT lang, quality, toxic, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "dict_remap": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "missing_results": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + 20 FROM orders)",
    "sweep_cross": f"WITH {SWEEP} SELECT label, q, round(rmse, 5) AS rmse, round(bits, 5) AS bits FROM sweep",
    "recon_join": f"WITH {FIELD} SELECT n, round(max(abs(v - round_even(v * 50, 0) / 50)), 6) AS maxe FROM field GROUP BY n",
    "prev_frame": "SELECT user_id, event_id, row_number() OVER w - 1 AS frame, row_number() OVER w = 1 AS key_frame, round(value - coalesce(lag(value) OVER w, 0), 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "full_outer_audit": "WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey + 20 AS k FROM orders) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL OUTER JOIN b ON a.k = b.k",
    "support_set": "WITH s AS (SELECT vec_id // 10 AS g, vec_id AS n, coalesce(list(vec_id) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS l FROM embeddings) SELECT g, n, array_to_string(l[1:4], ',') AS support FROM s",
    "knn_join": f"WITH {CLOUD} SELECT cloud, p, b_p, round(d2, 9) AS d2, rank::INTEGER AS rank FROM {nearest('true', 'true', 4)}",
    "ball_query": f"""WITH {CLOUD}, hit AS (SELECT a.cloud, a.p, b.p AS b_p, row_number() OVER (PARTITION BY a.cloud, a.p ORDER BY b.p) AS r FROM cloud a JOIN cloud b ON a.cloud = b.cloud AND {D2} <= 0.25),
      g AS (SELECT cloud, p, list(b_p ORDER BY b_p) AS l FROM hit WHERE r <= 8 GROUP BY ALL) SELECT cloud, p, slot, coalesce(l[slot + 1], l[1]) AS b_p FROM g, (SELECT unnest(range(0, 8)) AS slot) s""",
    "chamfer": f"WITH {CLOUD}, f AS (SELECT cloud, avg(d2) AS there FROM {nearest('p % 2 = 0', 'p % 2 = 1', 1)} GROUP BY cloud), g AS (SELECT cloud, avg(d2) AS back FROM {nearest('p % 2 = 1', 'p % 2 = 0', 1)} GROUP BY cloud) SELECT cloud, round(there + back, 6) AS chamfer FROM f JOIN g USING (cloud)",
    "mutual_nn_density": f"WITH {CLOUD}, m AS (SELECT cloud, p, b_p AS f, d2 FROM {nearest('p % 5 = 0', 'true', 8)}), o AS (SELECT cloud, p AS f, b_p AS p FROM {nearest('true', 'p % 5 = 0', 1)}) SELECT cloud, p, count(*) AS size, round(avg(sqrt(d2)), 6) AS distance FROM m JOIN o USING (cloud, p, f) GROUP BY cloud, p",
    "idw3": f"WITH {CLOUD}, k AS (SELECT * FROM {nearest('p % 2 = 0', 'p % 2 = 1', 3)}) SELECT k.cloud, k.p, round(sum(z / (d2 + 1e-8)) / sum(1 / (d2 + 1e-8)), 6) AS value FROM k JOIN cloud c ON c.p = k.b_p GROUP BY k.cloud, k.p",
    "unit_clouds": f"WITH {CLOUD}, m AS (SELECT cloud, p, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM cloud WINDOW w AS (PARTITION BY cloud)), n AS (SELECT cloud, max(sqrt(x * x + y * y + z * z)) AS big FROM m GROUP BY cloud) SELECT cloud, p, round(x / big, 6) AS x, round(y / big, 6) AS y, round(z / big, 6) AS z FROM m JOIN n USING (cloud)",
    "farthest_points": f"""WITH RECURSIVE {CLOUD}, g AS (SELECT cloud, list({{'p': p, 'x': x, 'y': y, 'z': z}} ORDER BY p) AS l FROM cloud GROUP BY cloud),
      run AS (SELECT cloud, l, 0 AS pick, [l[1]] AS got FROM g UNION ALL SELECT cloud, l, pick + 1, list_append(got, l[list_position(d, list_max(d))]) FROM
        (SELECT *, list_transform(l, lambda a: list_min(list_transform(got, lambda b: {D2}))) AS d FROM run WHERE pick < 7) WHERE list_max(d) > 0)
      SELECT cloud, pick, got[pick + 1].p AS p FROM run""",
    "hash_sample": "SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(md5('1:' || o_orderkey), 1, 8))::BIGINT < 429496729",
    "rans_roundtrip": "SELECT l_suppkey AS supp, count(*) AS n, true AS same FROM lineitem GROUP BY l_suppkey",
    "union_sources": "SELECT source, k, count(*) AS n FROM (SELECT 'customer' AS source, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY source, k",
    "distinct_dense_rank": "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS rank FROM part",
    "param_disjoint": "WITH a AS (SELECT DISTINCT p_type FROM part WHERE p_size <= 25), b AS (SELECT DISTINCT p_type FROM part WHERE p_size > 25), x AS (SELECT p_type FROM part WHERE p_size <= 25 EXCEPT ALL SELECT p_type FROM part WHERE p_size > 25) SELECT 'shared' AS what, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'more_in_a', count(DISTINCT p_type) FROM x",
    "find_close": f"WITH {SWEEP}, r AS (SELECT label, q, round(rmse, 9) AS rmse FROM sweep), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(rmse - 0.05), q) AS i FROM r) SELECT label, q, round(rmse, 6) AS rmse FROM k WHERE i = 1",
    "topk_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "every_kth_first3": "SELECT user_id, event_id, r // 4 AS pick FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events) WHERE r % 4 = 0 AND r // 4 < 3",
    "resampled": "WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_nationkey, s_suppkey, place FROM r, (SELECT unnest(range(0, 6)) AS place) p WHERE place % n = i",
    "url_facts": r"SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '^\w+://([^/:]+)', 1) AS host, regexp_extract(url, '^\w+://[^/]+/(\w+)', 1) AS first, try_cast(nullif(regexp_extract(url, '/(\d+)(?:[?#]|$)', 1), '') AS BIGINT) AS number FROM pages",
    "video_names": "SELECT p_partkey, p_size * 16 AS width, p_size * 9 AS height, (24 + p_size % 3)::DOUBLE AS fps, (CASE WHEN p_size % 2 = 0 THEN 8 ELSE 10 END)::INTEGER AS bits, '420' AS chroma, floor(10000000 / ((p_size * 16 * p_size * 9 + 2 * (p_size * 8) * ceil(p_size * 9 / 2.0)) * CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END))::BIGINT AS frames FROM part",
    "json_props": "SELECT (props::JSON ->> 'k')::BIGINT AS k, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "header_pack_bits": f"SELECT p_partkey, {HEADER} AS header, p_partkey % 256 AS model, p_partkey % 3 AS metric, (p_size % 8 + 1)::BIGINT AS quality FROM part",
    "packed_bodies": f"SELECT p_partkey, {U32.format('p_size')} || {U32.format('p_size * 2')} || {U32.format('2')} || {U32.format('octet_length(encode(p_brand))')} || hex(encode(p_brand)) || {U32.format('octet_length(encode(p_type))')} || hex(encode(p_type)) AS body FROM part",
    "list_expand": "SELECT trim(p_name) AS clip, frame, trim(p_name) || '/im' || frame || '.png' AS path FROM (SELECT DISTINCT p_name FROM part WHERE trim(p_name) <> ''), (SELECT unnest(range(1, 4)) AS frame) f",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size FROM documents",
    "result_json": f"WITH {SWEEP} SELECT 'codec' || label AS name, 'psnr-rgb' AS metric, (q - 1)::BIGINT AS i, round(-20 * log10(rmse), 5) AS value FROM sweep UNION ALL SELECT 'codec' || label, 'bits', q - 1, round(bits, 5) FROM sweep",
    "tumbling": "SELECT event_type, strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding": "SELECT event_type, strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - to_days(k::INTEGER), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest(range(0, 2)) AS k) s GROUP BY ALL",
    "sessions": "WITH g AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w >= INTERVAL 4 HOURS, true)::INTEGER AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), t AS (SELECT user_id, k, count(*) AS n, sum(value) AS total FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest, round(sum(total), 4) AS total FROM t GROUP BY user_id",
    "event_frames": "SELECT user_id, count(*) AS frames, 1::BIGINT AS key_frames, round(arg_max(value, ts), 4) AS last FROM events GROUP BY user_id",
}
