"""Queries of scalar functions, call paths, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadlens.functions import paths as P
from loadlens.functions import scalars as S
from loadlens.operators import densify as D
from loadlens.operators.checkpoints import scratch
from loadlens.plans.catalog import query, r6, sql_r6
from loadlens.sources import binary, store, symtab, textmatrix
from loadlens.sources import fixtures as X
from loadlens.sources.regiondb import RegionDB
from loadlens.streaming import comm, steps

E, PATHS, SYM, SHIP = X.EFFORT_SQL, X.PATHS_SQL, X.SYMBOLS_SQL, X.SHIPMENTS_SQL


LE = "CASE WHEN n <= 0 THEN 0 ELSE CAST(1 AS BIGINT) << (length(bin(n)) - 1) END"
GE = "CASE WHEN n <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(bin(n - 1)) END"


@query("f01_f04_powers_of_two", f"SELECT n, n & (n - 1) = 0 OR n = 0 AS is_pow2, {GE} AS ge, {LE} AS le, CAST(CASE WHEN n = 0 THEN -1 ELSE length(bin(n)) - 1 END AS INTEGER) AS log2 FROM (SELECT CAST(range AS BIGINT) AS n FROM range(1025))")
def _(spark, d):
    n = spark.range(1025).withColumnRenamed("id", "n")
    return n.select("n", S.is_power_of_2("n").alias("is_pow2"), S.ge_power_of_2("n").alias("ge"), S.le_power_of_2("n").alias("le"), S.log2_pow2("n").cast("int").alias("log2"))


@query("f05_abs", f"WITH {E} SELECT region, rank, step, abs(v - 50) AS a FROM effort")
def _(spark, d):
    return X.effort(spark, d).select("region", "rank", "step", F.abs(F.col("v") - 50).alias("a"))


@query("f09_f10_normal_quantile")
def _(spark, d):
    p = spark.range(1, 1000).select((F.col("id") / 1000).alias("p"))
    return p.select("p", r6(S.normal_quantile_column("p")).alias("z"), r6(S.normal_quantile_column((F.col("p") + 1) / 2)).alias("confidence_z"))


TEXT_SQL = "SELECT c_custkey, c_name, c_mktsegment FROM customer"


@query("f14_f15_split", "SELECT c_custkey, list_filter(string_split_regex(c_name || ' a-b#c', '[#\\- ]'), lambda x: x <> '') AS any_of, list_filter(string_split(c_name || '=>' || c_mktsegment, '=>'), lambda x: x <> '') AS parts FROM customer")
def _(spark, d):
    c = X.table(spark, d, "customer")
    return c.select("c_custkey", S.split_any(F.concat("c_name", F.lit(" a-b#c")), "#- ").alias("any_of"), S.split_str(F.concat("c_name", F.lit("=>"), "c_mktsegment"), "=>").alias("parts"))


@query("f16_f17_trim_repeat", "SELECT n_nationkey, trim('..' || n_name || '. ', '. ') AS t, repeat(n_name, 3) AS r FROM nation")
def _(spark, d):
    return X.table(spark, d, "nation").select("n_nationkey", S.trim_chars(F.concat(F.lit(".."), "n_name", F.lit(". ")), ". ").alias("t"), F.repeat("n_name", F.lit(3)).alias("r"))


PATH_TEXT = "(SELECT path_id, string_agg(module || '(0x' || lower(hex(off)) || ')', ' : ' ORDER BY depth DESC) AS text FROM frame GROUP BY 1)"


@query("f18_parse_paths", f"WITH {PATHS} SELECT path_id, CAST(depth AS INTEGER) AS depth, module, off FROM frame")
def _(spark, d):
    made = P.spread(X.paths(spark, d), "path_id").select("path_id", P.path_text("path").alias("text")).select("path_id", P.make_path("text").alias("path"))
    return P.each(made, "path", "depth", "f").select("path_id", "depth", "f.module", "f.off")


@query("f20_o06_path_text", f"WITH {PATHS} SELECT path_id, text, '[time 0 ' || text || ' => null_callpath]' AS key FROM {PATH_TEXT}")
def _(spark, d):
    nothing = F.lit(None).cast("array<struct<module: string, off: bigint>>")
    return X.paths(spark, d).select("path_id", P.path_text("path").alias("text"), P.key_text(F.lit("time"), F.lit(0), F.col("path"), nothing).alias("key"))


@query("f19_parse_keys", f"WITH {PATHS} SELECT path_id, CAST(k.k AS INTEGER) AS place, 'time' AS metric, 0 AS type, CASE WHEN k.k = 0 THEN text ELSE text END AS start_text, text AS end_text FROM {PATH_TEXT}, (VALUES (0), (1)) k(k)")
def _(spark, d):
    t = P.path_text("path")
    texts = P.spread(X.paths(spark, d), "path_id").select("path_id", t.alias("t"))
    keys = texts.select("path_id", P.parse_keys(F.concat("t", F.lit("=>"), "t", F.lit(","), "t")).alias("k"))
    return P.each(keys, "k", "place", "x").select("path_id", "place", "x.metric", "x.type", P.path_text(F.col("x.start")).alias("start_text"), P.path_text(F.col("x.end")).alias("end_text"))


SYMBOLIZED = f"{PATHS}, {SYM}, named AS (SELECT path_id, depth, coalesce(target, module) AS module, off FROM frame LEFT JOIN alias ON alias.alias = frame.module), found AS (SELECT path_id, depth, n.module, n.off, coalesce(file, '??') AS file, coalesce(line, 0) AS line, coalesce(symbol, '??') AS symbol FROM named n LEFT JOIN symtab s ON s.module = n.module AND s.off = n.off)"


def frames(spark, d):
    return X.paths(spark, d).select("path_id", F.posexplode("path").alias("depth", "f")).select("path_id", "depth", "f.module", "f.off")


def found(spark, d):
    return P.symbolize(frames(spark, d), X.symbols(spark, d), X.aliases(spark, d))


@query("j01_j02_symbolize", f"WITH {SYMBOLIZED} SELECT path_id, depth, module, off, file, line, symbol FROM found")
def _(spark, d):
    return found(spark, d)


@query("f21_location_text", f"WITH {SYMBOLIZED} SELECT path_id, depth, CASE WHEN symbol = '??' THEN 'unknown in ' || module ELSE symbol || '(' || file || ':' || CAST(line AS VARCHAR) || ')' END AS text FROM found")
def _(spark, d):
    return found(spark, d).select("path_id", "depth", P.location_text("file", "line", "symbol", "module").alias("text"))


@query("f22_frame_info_text", f"WITH {SYMBOLIZED} SELECT path_id, depth, file || ':' || CAST(line AS VARCHAR) || ' ' || symbol || ' ' || module || '(0x' || lower(hex(off)) || ')' AS text FROM found")
def _(spark, d):
    return found(spark, d).select("path_id", "depth", P.frame_info_text("file", "line", "symbol", "module", "off").alias("text"))


@query("f23_encodings", "SELECT * FROM (VALUES ('RLE', 1), ('Huffman', 2), ('ARITHMETIC', 3), ('none', 0), ('zip', NULL)) t(name, code)")
def _(spark, d):
    return spark.createDataFrame([("RLE",), ("Huffman",), ("ARITHMETIC",), ("none",), ("zip",)], "name string").withColumn("code", S.encoding_code("name"))


@query("f24_bits_to_bytes", "SELECT CAST(range AS BIGINT) AS bits, CAST((range + 7) // 8 AS BIGINT) AS bytes FROM range(200)")
def _(spark, d):
    return spark.range(200).select(F.col("id").alias("bits"), S.bits_to_bytes("id").alias("bytes"))


@query("f25_f26_bits", "SELECT CAST(range AS BIGINT) AS n, lpad(bin(range), 8, '0') AS byte, substr('000000000000', 1, range % 5) || substr(lpad(bin(range), 8, '0'), 1, range % 8) || substr('000000000000', range % 5 + range % 8 + 1) AS bits FROM range(200)")
def _(spark, d):
    n = spark.range(200).withColumn("byte", S.bits_text("id")).withColumn("zero", F.repeat(F.lit("0"), F.lit(12)))
    return n.select(F.col("id").alias("n"), "byte", S.insert_bits("zero", "byte", (F.col("id") % 8).cast("int"), (F.col("id") % 5).cast("int")).alias("bits"))


@query("f27_search_tree", "WITH RECURSIVE t AS (SELECT 0 AS lo, 36 AS hi, -1 AS parent UNION ALL SELECT * FROM (SELECT CASE WHEN s.s = 0 THEN lo ELSE (lo + hi) // 2 + 1 END AS l, CASE WHEN s.s = 0 THEN (lo + hi) // 2 - 1 ELSE hi END AS h, (lo + hi) // 2 AS p FROM t, (VALUES (0), (1)) s(s)) WHERE l <= h) SELECT CAST((lo + hi) // 2 AS BIGINT) AS rank, CAST(parent AS BIGINT) AS parent FROM t")
def _(spark, d):
    return spark.createDataFrame([(a, b) for a, b, _, _ in S.search_tree(37)], "rank long, parent long")


@query("f28_radix_tree", "WITH r AS (SELECT range AS rank, range + 1 AS n, length(bin(range + 1)) - 1 AS m FROM range(500)) SELECT CAST(rank AS BIGINT) AS rank, CAST(CASE WHEN n = 1 THEN -1 ELSE ((CAST(1 AS BIGINT) << (m - 1)) | (n & ((CAST(1 AS BIGINT) << (m - 1)) - 1))) - 1 END AS BIGINT) AS parent, CAST(CASE WHEN ((CAST(1 AS BIGINT) << (m + 1)) | (n & ((CAST(1 AS BIGINT) << m) - 1))) - 1 >= 500 THEN -1 ELSE ((CAST(1 AS BIGINT) << (m + 1)) | (n & ((CAST(1 AS BIGINT) << m) - 1))) - 1 END AS BIGINT) AS left_child FROM r")
def _(spark, d):
    return spark.range(500).select(F.col("id").alias("rank"), S.radix_parent("id").alias("parent"), S.radix_child("id", 0, 500).alias("left_child"))


@query("f30_metric_list", "SELECT list_filter(string_split_regex('time, PAPI_TOT_CYC  PAPI_FP_OPS,x', '[ ,]'), lambda x: x <> '' AND x <> 'time') AS metrics, TRUE AS has_time")
def _(spark, d):
    names = S.split_any(F.lit("time, PAPI_TOT_CYC  PAPI_FP_OPS,x"), " ,")
    return spark.range(1).select(F.filter(names, lambda x: x != "time").alias("metrics"), F.array_contains(names, "time").alias("has_time"))


@query("f31_call_site", f"WITH {PATHS} SELECT path_id, depth, greatest(off - 1, 0) AS off FROM frame")
def _(spark, d):
    return frames(spark, d).select("path_id", "depth", F.greatest(F.col("off") - 1, F.lit(0).cast("long")).alias("off"))


@query("f33_invert_permutation", "SELECT CAST(n AS BIGINT) AS n, list_transform(range(7), lambda i: list_position(list_transform(range(7), lambda j: (j * n) % 7), i) - 1) AS inverse FROM (VALUES (1), (2), (3), (5)) t(n)")
def _(spark, d):
    n = spark.createDataFrame([(1,), (2,), (3,), (5,)], "n long")
    p = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: ((j * F.col("n")) % 7).cast("int"))
    return n.select("n", S.invert_permutation(p).alias("inverse"))


@query("s12_varint", "WITH r AS (SELECT CAST(range * 17 AS BIGINT) AS n FROM range(3000)) SELECT n, CASE WHEN n < 128 THEN printf('%02X', n) WHEN n < 16384 THEN printf('%02X', (n & 127) | 128) || printf('%02X', n >> 7) ELSE printf('%02X', (n & 127) | 128) || printf('%02X', ((n >> 7) & 127) | 128) || printf('%02X', n >> 14) END AS hex, n AS back FROM r")
def _(spark, d):
    n = spark.range(3000).select((F.col("id") * 17).alias("n"))
    return n.select("n", S.varint_hex("n").alias("hex")).withColumn("back", S.from_varint_hex("hex"))


@query("s13_fixed_width", "WITH r AS (SELECT CAST(range * 17 AS BIGINT) AS n FROM range(3000)) SELECT n, printf('%02X', n & 255) || printf('%02X', (n >> 8) & 255) || printf('%02X', (n >> 16) & 255) || printf('%02X', (n >> 24) & 255) AS hex FROM r")
def _(spark, d):
    return spark.range(3000).select((F.col("id") * 17).alias("n")).withColumn("hex", S.fixed_hex("n", 4))


def topo_order_sql() -> str:
    """Corners, edges, faces, inside of a 4 x 4 x 4 grid by how many coordinates lie on the border."""
    border = "(x IN (0, 3))::INT + (y IN (0, 3))::INT + (z IN (0, 3))::INT"
    return f"WITH g AS (SELECT CAST(range AS BIGINT) AS rank, range % 4 AS x, range // 4 % 4 AS y, range // 16 AS z FROM range(64)), b AS (SELECT *, {border} AS on_border FROM g), o AS (SELECT *, CASE on_border WHEN 3 THEN 0 WHEN 2 THEN CASE WHEN x IN (1, 2) THEN 1 WHEN y IN (1, 2) THEN 2 ELSE 3 END WHEN 1 THEN CASE WHEN z IN (0, 3) THEN 4 WHEN y IN (0, 3) THEN 5 ELSE 6 END ELSE 7 END AS class FROM b), s AS (SELECT *, CASE class WHEN 1 THEN (y, z, x) WHEN 2 THEN (x, z, y) WHEN 3 THEN (x, y, z) WHEN 4 THEN (z, x, y) WHEN 5 THEN (y, x, z) WHEN 6 THEN (x, y, z) ELSE (x, y, z) END AS k FROM o) SELECT rank, row_number() OVER (ORDER BY class, k) - 1 AS place FROM s"


@query("t24_topology_order", topo_order_sql())
def _(spark, d):
    from loadlens.operators.topology import grid_order

    return grid_order(spark, 4, 4, 4)


# ---- paths ----

@query("f28_radix_preorder", "SELECT row_number() OVER (ORDER BY reverse(substr(bin(range + 1), 2))) - 1 AS place, CAST(range AS BIGINT) AS rank FROM range(3000)")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(S.radix_preorder(3000))), "place long, rank long")


@query("p06_comm_keys", "SELECT count(*) AS n FROM events WHERE event_type = 'view'")
def _(spark, d):
    e = X.table(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("a"))
    return e.where(P.is_comm("a", "a")).agg(F.count("*").alias("n"))


@query("p07_p08_j08_guides", "SELECT c_custkey AS path_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)")
def _(spark, d):
    guides = X.table(spark, d, "region").where("r_regionkey in (1, 3)").select(F.array(F.struct(F.col("r_name").alias("module"), F.col("r_regionkey").cast("long").alias("off"))).alias("guide"))
    return P.keep_guided(X.paths(spark, d), guides).select("path_id")


@query("p13_p15_trim_chop_slice", f"WITH {PATHS} SELECT path_id, count(*) FILTER (depth < 2) AS inner_two, CASE WHEN bool_or(depth = 1 AND module = '[unknown module]') THEN 1 ELSE 3 END AS chopped, 2 AS trimmed FROM frame GROUP BY 1")
def _(spark, d):
    p = X.paths(spark, d)
    return p.select("path_id", F.size(P.slice_path("path", 0, 2)).cast("long").alias("inner_two"), F.size(P.chop_at("path", "[unknown module]")).alias("chopped"), F.size(P.trim_wrappers("path", lambda f: f["module"] == F.get("path", 0)["module"])).alias("trimmed"))


@query("u04_distinct_paths", "SELECT count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    return X.paths(spark, d).select("path").distinct().agg(F.count("*").alias("n"))


@query("u05_corner_points", "SELECT DISTINCT a.v AS x, b.v AS y, c.v AS z FROM (VALUES (0), (3)) a(v), (VALUES (0), (0)) b(v), (VALUES (0), (1)) c(v)")
def _(spark, d):
    rows = [(x, y, z) for x in (0, 3) for y in (0, 0) for z in (0, 1)]
    return spark.createDataFrame(rows, "x int, y int, z int").distinct()


@query("o08_x17_nearest_symbol", "WITH s AS (SELECT n_regionkey AS module, n_nationkey * 10 AS addr, n_name AS symbol FROM nation), q AS (SELECT DISTINCT c_nationkey % 5 AS module, c_custkey % 260 AS off FROM customer) SELECT CAST(q.module AS VARCHAR) AS module, CAST(q.off AS BIGINT) AS off, arg_max(s.symbol, s.addr) AS symbol, CAST(max(s.addr) AS BIGINT) AS addr FROM q LEFT JOIN s ON s.module = q.module AND s.addr <= q.off GROUP BY 1, 2")
def _(spark, d):
    s = X.table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("module"), (F.col("n_nationkey") * 10).cast("long").alias("addr"), F.col("n_name").alias("symbol"))
    q = X.table(spark, d, "customer").select((F.col("c_nationkey") % 5).cast("string").alias("module"), (F.col("c_custkey") % 260).alias("off")).distinct()
    return P.nearest_symbol(q, s)


# ---- files ----

@query("s01_s02_text_matrix", f"WITH {E} SELECT rank, step, v FROM effort WHERE region = 'click'")
def _(spark, d):
    path = scratch(spark)
    rows = D.to_rows(X.effort(spark, d).where("region = 'click'"), ["rank"])
    textmatrix.write_matrix(rows, path)
    return D.to_long(textmatrix.read_matrix(spark, f"{path}/part-*"), ["rank"])


@query("s05_s06_s08_store_round_trip", f"WITH {SHIP} SELECT region, rank, count(*) AS n FROM ship WHERE metric = 'quantity' GROUP BY 1, 2")
def _(spark, d):
    path = scratch(spark)
    rows = D.sparse_to_rows(X.shipments(spark, d), ["metric", "region", "rank"], 128)
    store.write_effort(rows, path)
    nonzero = F.size(F.filter("vals", lambda v: v != 0)).cast("long")
    return store.read_effort(spark, path, "quantity").select("region", "rank", nonzero.alias("n"))


@query("s03_metadata_scan", f"WITH {SHIP} SELECT DISTINCT metric, region, rank FROM ship")
def _(spark, d):
    path = scratch(spark)
    store.write_effort(D.sparse_to_rows(X.shipments(spark, d), ["metric", "region", "rank"], 128), path)
    return store.read_metadata(spark, path)


@query("s07_file_names", "SELECT * FROM (VALUES ('effort-time-0-12', 'time', 0, 12), ('effort-x-y-1', NULL, NULL, NULL), ('other-time-0-1', NULL, NULL, NULL), ('effort-time-3', NULL, NULL, NULL)) t(name, metric, type, number)")
def _(spark, d):
    names = spark.createDataFrame([("effort-time-0-12",), ("effort-x-y-1",), ("other-time-0-1",), ("effort-time-3",)], "name string")
    return names.withColumn("p", store.parse_file_name(F.col("name"))).select("name", "p.metric", "p.type", "p.number")


@query("s09_s10_path_bytes", f"WITH {PATHS} SELECT path_id, CAST(depth AS INTEGER) AS depth, module, off FROM frame")
def _(spark, d):
    back = X.paths(spark, d).select("path_id", binary.path_bytes(F.col("path")).alias("b")).select("path_id", binary.path_from_bytes(F.col("b")).alias("path"))
    return back.select("path_id", F.posexplode("path").alias("depth", "f")).select("path_id", "depth", "f.module", "f.off")


KEY_SIDES = "SELECT path_id, 'time' AS metric, CAST(path_id % 3 AS INTEGER) AS kind, {} AS side, CAST(depth AS INTEGER) AS depth, module, off FROM frame"


@query("s09_key_bytes", f"WITH {PATHS} {KEY_SIDES.format("'start'")} UNION ALL {KEY_SIDES.format("'end'")} WHERE path_id % 2 = 0")
def _(spark, d):
    """Whole keys through their bytes; every other one has no end path."""
    end = F.when(F.col("path_id") % 2 == 0, F.col("path"))
    coded = X.paths(spark, d).select("path_id", binary.key_bytes(F.lit("time"), (F.col("path_id") % 3).cast("int"), F.col("path"), end).alias("b"))
    key = coded.select("path_id", binary.key_from_bytes(F.col("b")).alias("k")).select("path_id", "k.*")
    sides = key.select("path_id", "metric", "kind", F.explode(F.create_map(F.lit("start"), "start", F.lit("end"), "end")).alias("side", "path"))
    return sides.select("path_id", "metric", "kind", "side", F.posexplode("path").alias("depth", "f")).select("path_id", "metric", "kind", "side", "depth", "f.module", "f.off")


#: Header fields by key of an order; written for both dialects.
HEADER_FIELDS = {
    "rows": "o_custkey",
    "cols": "o_orderkey",
    "level": "o_orderkey % 12",
    "mean": "o_custkey - o_orderkey * 1000",
    "scale": "1024",
    "threshold": "CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE shiftleft(CAST(1 AS BIGINT), CAST(o_orderkey % 40 AS INTEGER)) END",
    "encoding": "o_orderkey % 4",
    "blocks": "1 + o_custkey % 200",
    "passes": "o_orderkey % 61",
    "ezw_size": "o_orderkey * 3",
    "rle_size": "o_orderkey * 2",
    "enc_size": "o_orderkey",
}
HEADER_SQL = ", ".join(f"CAST({v.replace('shiftleft(CAST(1 AS BIGINT), CAST(o_orderkey % 40 AS INTEGER))', 'CAST(1 AS BIGINT) << (o_orderkey % 40)')} AS BIGINT) AS {k}" for k, v in HEADER_FIELDS.items())
VARINT_SIZE = " + ".join(f"greatest(1, (length(bin({k})) + 6) // 7)" for k in HEADER_FIELDS if k not in ("mean", "threshold", "encoding"))


@query("s11_header_bytes", f"WITH h AS (SELECT o_orderkey, {HEADER_SQL} FROM orders) SELECT *, CAST({VARINT_SIZE} + 10 AS INTEGER) AS n_bytes FROM h")
def _(spark, d):
    """Headers through their bytes, and how many there are: varints by their bits, 10 bytes for mean, threshold and encoding."""
    header = F.struct(*[F.expr(v).cast("long").alias(k) for k, v in HEADER_FIELDS.items()])
    coded = X.table(spark, d, "orders").select("o_orderkey", binary.header_bytes(header).alias("b"))
    return coded.select("o_orderkey", binary.header_from_bytes(F.col("b")).alias("h"), F.octet_length("b").alias("n_bytes")).select("o_orderkey", "h.*", "n_bytes")


@query("s14_symbol_scan", f"WITH {SYM} SELECT module, off, file, line, symbol FROM symtab UNION ALL SELECT target, NULL, NULL, NULL, alias FROM alias")
def _(spark, d):
    lines = X.symbols(spark, d).select(symtab.symbol_line(*[F.col(c) for c in ("file", "line", "symbol", "module", "off")]).alias("value"))
    named = X.aliases(spark, d).select(F.concat("alias", F.lit(" => "), "target").alias("value"))
    symbols, aliases = symtab.parse_symbols(lines.unionByName(named))
    none = F.lit(None)
    return symbols.unionByName(aliases.select(F.col("target").alias("module"), none.cast("long").alias("off"), none.cast("string").alias("file"), none.cast("int").alias("line"), F.col("alias").alias("symbol")))


@query("s15_s16_times", "SELECT event_type AS name, CAST(sum(event_id) * 1000 AS BIGINT) AS ns FROM events GROUP BY 1 UNION ALL SELECT 'Total', CAST(sum(event_id) * 1000 AS BIGINT) FROM events")
def _(spark, d):
    t = X.table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.min("event_id").alias("first"), (F.sum("event_id") * 1000).alias("ns"))
    return symtab.parse_times(symtab.times_lines(t))


@query("s19_keys_dump", f"WITH {PATHS} SELECT DISTINCT '[time 0 ' || text || ' => ' || text || ']' AS value FROM {PATH_TEXT}")
def _(spark, d):
    return X.paths(spark, d).select(P.key_text(F.lit("time"), F.lit(0), "path", "path").alias("value")).distinct()


@query("s22_exact_concat", "SELECT 'a' AS effort, CAST(range AS BIGINT) AS rank, range AS row FROM range(12)")
def _(spark, d):
    parts = spark.range(12).select(F.concat(F.lit("exact-a-"), F.col("id").cast("string")).alias("name"), F.array(F.col("id").cast("double")).alias("vals"))
    return textmatrix.concat_parts(parts).select("effort", "rank", F.col("row").cast("long").alias("row"))


@query("s23_u06_viewer_symbols", f"WITH {SYMBOLIZED} SELECT DISTINCT CASE WHEN file = '??' THEN '?' ELSE file END || '|' || CAST(line AS VARCHAR) || '|' || CASE WHEN symbol = '??' THEN '?' ELSE symbol END || '|' || module || '|0x' || lower(hex(off)) AS line FROM found")
def _(spark, d):
    text = P.frame_info_text("file", "line", "symbol", "module", "off")
    return symtab.build_symbols(found(spark, d).select(text.alias("value")))


# ---- events and streams ----

COMM_SQL = """c AS (SELECT user_id % 16 AS rank, ts, event_id, event_type AS path, row_number() OVER w AS place, lag(ts) OVER w AS since, lag(event_type) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id % 16 ORDER BY ts, event_id))"""


def comm_events(spark, d):
    return X.table(spark, d, "events").select(F.expr("user_id % 16").alias("rank"), "ts", "event_id", F.col("event_type").alias("path"))


@query("x02_comm_regions", f"WITH {COMM_SQL} SELECT CASE WHEN place % 2 = 1 THEN last END AS start_path, CASE WHEN place % 2 = 1 THEN path END AS end_path, count(*) AS n, CAST(sum(date_diff('microsecond', since, ts)) AS BIGINT) AS elapsed FROM c WHERE since IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return comm.comm_regions(comm_events(spark, d)).groupBy("start_path", "end_path").agg(F.count("*").alias("n"), F.sum("elapsed").alias("elapsed"))


@query("x03_phase_marks", "SELECT event_id, last_value(CASE WHEN event_id % 7 = 0 THEN event_id % 3 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS type FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return X.table(spark, d, "events").select("event_id", F.last(F.expr("case when event_id % 7 = 0 then event_id % 3 end"), True).over(w).alias("type"))


@query("x04_user_metrics", f"SELECT metric, count(*) AS n, {sql_r6('sum(v)', 3)} AS total FROM (SELECT 'value' AS metric, value AS v FROM events UNION ALL SELECT 'half', value / 2 FROM events) GROUP BY 1")
def _(spark, d):
    both = X.table(spark, d, "events").select(F.expr("stack(2, 'value', value, 'half', value / 2) as (metric, v)"))
    return both.groupBy("metric").agg(F.count("*").alias("n"), r6(F.sum("v"), 3).alias("total"))


@query("x06_reset_without_record", f"WITH {COMM_SQL} SELECT rank, CAST(coalesce(sum(CASE WHEN event_id % 10 <> 0 THEN date_diff('microsecond', since, ts) END), 0) AS BIGINT) AS elapsed FROM c WHERE since IS NOT NULL GROUP BY 1")
def _(spark, d):
    regions = comm.comm_regions(comm_events(spark, d))
    kept = F.when(F.col("event_id") % 10 != 0, F.col("elapsed"))
    return regions.groupBy("rank").agg(F.coalesce(F.sum(kept), F.lit(0).cast("long")).alias("elapsed"))


@query("x16_stack_walk", f"WITH {PATHS} SELECT count(*) AS walks, count(*) FILTER (module = '[unknown module]') AS bad FROM frame WHERE depth = 1")
def _(spark, d):
    p = X.paths(spark, d).select(P.slice_path("path", 1).alias("path"))
    return p.agg(F.count("*").alias("walks"), F.count_if(F.get("path", 0)["module"] == "[unknown module]").alias("bad"))


@query("x01_progress_steps", f"WITH {E} SELECT step, {sql_r6('sum(v)', 3)} AS v, count(*) AS n FROM fact GROUP BY 1")
def _(spark, d):
    return X.event_facts(spark, d).groupBy("step").agg(r6(F.sum("v"), 3).alias("v"), F.count("*").alias("n"))


@query("x01_x08_streamed_steps", f"WITH {E} SELECT region, rank, step, v FROM fact")
def _(spark, d):
    """The same totals as the batch ones, out of a stream that is drained."""
    schema = X.table(spark, d, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(events_folder(spark, d, schema))
    stream = files.withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"steps_{uuid.uuid4().hex}"
    return steps.run_to_table(steps.step_totals(stream), name, scratch(spark))


TRACE_SQL = "SELECT '{}' AS listener, CAST(event_id % 3 AS INTEGER) AS batch, '    [' || event_type || ' ' || CAST(user_id % 16 AS VARCHAR) || ']' || CAST(event_id AS VARCHAR) AS value FROM events"


@query("x05_s17_trace_listeners", f"{TRACE_SQL.format('trace')} UNION ALL {TRACE_SQL.format('second')} WHERE event_id % 3 = 1")
def _(spark, d):
    """Events arrive in three batches; one listener traces each of them, another every second one."""
    events, folder, checkpoint = X.table(spark, d, "events"), scratch(spark), scratch(spark)
    traces = {"trace": 1, "second": 2}
    paths = {name: scratch(spark) for name in traces}
    listeners = {name: (every, lambda batch, number, to=paths[name]: steps.append_trace(batch, to, number)) for name, every in traces.items()}
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(folder)
        facts = spark.readStream.schema(events.schema).parquet(folder).select(F.col("event_type").alias("region"), F.expr("user_id % 16").alias("rank"), F.col("event_id").alias("v"))
        steps.with_listeners(facts, listeners, checkpoint, "append").trigger(availableNow=True).start().awaitTermination()
    read = [spark.read.parquet(path).select(F.lit(name).alias("listener"), F.col("batch").cast("int").alias("batch"), "value") for name, path in paths.items()]
    return read[0].unionByName(read[1])


def events_folder(spark, d, schema) -> str:
    """A folder of events alone, for the file stream."""
    path = scratch(spark)
    X.table(spark, d, "events").write.parquet(path)
    return path


@query("x12_region_db", f"WITH {SHIP} SELECT region, list(metric ORDER BY metric) AS metrics FROM (SELECT DISTINCT region, metric FROM ship) GROUP BY 1")
def _(spark, d):
    return RegionDB(X.shipments(spark, d), (X.RANKS, X.STEPS)).regions()


@query("x12_region_totals", f"WITH {SHIP}, s AS (SELECT region, sum(v) AS v FROM ship WHERE metric = 'price' GROUP BY 1) SELECT region, {sql_r6('v', 2)} AS total, {sql_r6('100 * v / (SELECT sum(v) FROM s)')} AS percent FROM s")
def _(spark, d):
    found = RegionDB(X.shipments(spark, d), (X.RANKS, X.STEPS)).totals("price")
    return found.select("region", r6("total", 2).alias("total"), r6("percent").alias("percent"))


@query("x12_stored_surface", f"WITH {E} SELECT rank, step, {sql_r6('sum(v)', 4)} AS v FROM effort WHERE region IN ('click', 'view') GROUP BY 1, 2")
def _(spark, d):
    """Saved, loaded, selected and summed."""
    path = scratch(spark)
    RegionDB(X.event_facts(spark, d).withColumn("metric", F.lit("value")), (X.RANKS, X.STEPS)).save(path)
    found = RegionDB.load(spark, path, (X.RANKS, X.STEPS)).where("region in ('click', 'view')").surface("value")
    return found.select("rank", "step", r6("v", 4).alias("v"))