"""Queries of wavelet transforms, codecs and similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadlens.functions import scalars as S
from loadlens.operators import allpoints, cluster, codec, effortlog, sampling, ssim, stats, wavelet
from loadlens.operators import densify as D
from loadlens.operators.checkpoints import checkpointed, scratch
from loadlens.plans.catalog import query, r6, sql_r6
from loadlens.sources import fixtures as X
from loadlens.sources.regiondb import RegionDB

E, SIG = X.EFFORT_SQL, X.SIGNALS_SQL
A, K = wavelet.LIFT, wavelet.SCALE
SHAPE = X.RANKS, X.STEPS


def sql_forward(name: str, src: str, parts: str, at: str, n: int, where: str = "TRUE") -> str:
    """CTEs of one lifting level of src(parts, at, v) to name; rows outside where pass through."""
    w = f"WINDOW w AS (PARTITION BY {parts} ORDER BY {at})"
    out, last = [f"{name}_0 AS (SELECT * FROM {src} WHERE {where})"], f"{name}_0"
    for i, a in enumerate(A):
        odd = 1 - i % 2
        moved = f"v + {a!r} * (coalesce(lag(v) OVER w, lead(v) OVER w) + coalesce(lead(v) OVER w, lag(v) OVER w))"
        out.append(f"{name}_{i + 1} AS (SELECT * REPLACE (CASE WHEN {at} % 2 = {odd} THEN {moved} ELSE v END AS v) FROM {last} {w})")
        last = f"{name}_{i + 1}"
    out.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {at} % 2 = 1 THEN {n // 2} + {at} // 2 ELSE {at} // 2 END AS {at}, CASE WHEN {at} % 2 = 1 THEN v / {K!r} ELSE v * {K!r} END AS v) FROM {last} UNION ALL SELECT * FROM {src} WHERE NOT ({where}))")
    return ", ".join(out)


def sql_levels(name: str, src: str, parts: str, at: str, n: int, level: int) -> str:
    out, last = [], src
    for k in range(level):
        to = name if k == level - 1 else f"{name}_l{k}"
        out.append(sql_forward(to, last, parts, at, n >> k, f"{at} < {n >> k}"))
        last = to
    return ", ".join(out)


def sql_levels2(name: str, src: str, parts: str, rows: int, cols: int, level: int) -> str:
    out, last = [], src
    for k in range(level):
        r, c = rows >> k, cols >> k
        inside = f"rank < {r} AND step < {c}"
        out.append(sql_forward(f"{name}_r{k}", last, f"{parts}, rank", "step", c, inside))
        to = name if k == level - 1 else f"{name}_c{k}"
        out.append(sql_forward(to, f"{name}_r{k}", f"{parts}, step", "rank", r, inside))
        last = to
    return ", ".join(out)


SIG1 = "s AS (SELECT id, CAST(pos AS BIGINT) AS pos, v FROM sig)"


def effort_rows(spark, d):
    return D.to_rows(X.effort(spark, d), ["region", "rank"])


def long6(rows, keys, at="step"):
    return D.to_long(rows, keys, at).withColumn("v", r6("v"))


@query("w01_t05_lifting_window", f"WITH {E}, {sql_forward('t', 'effort', 'region, rank', 'step', 64)} SELECT region, rank, step, {sql_r6('v')} AS v FROM t")
def _(spark, d):
    return wavelet.lift_long(X.effort(spark, d), ["region", "rank"], "step", 64).select("region", "rank", F.col("step").cast("long").alias("step"), r6("v").alias("v"))


@query("t05_lifting_arrays", f"WITH {E}, {sql_forward('t', 'effort', 'region, rank', 'step', 64)} SELECT region, rank, step, {sql_r6('v')} AS v FROM t")
def _(spark, d):
    return long6(effort_rows(spark, d).withColumn("vals", wavelet.dwt(F.col("vals"), 1)), ["region", "rank"])


TAPS_SQL = "taps AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {lo!r}, {hi!r})" for i, (lo, hi) in enumerate(zip(wavelet.taps(wavelet.LOW_HALF), wavelet.taps(wavelet.HIGH_HALF), strict=True))) + ") t(d, lo, hi))"


@query(
    "t01_t03_direct_convolution",
    f"""WITH {SIG}, {TAPS_SQL}, o AS (SELECT range AS i FROM range(32)),
low AS (SELECT id, o.i AS pos, sum(lo * v) AS v FROM o CROSS JOIN taps JOIN sig ON sig.pos = CASE WHEN abs(2 * o.i + d - 4) > 63 THEN 126 - abs(2 * o.i + d - 4) ELSE abs(2 * o.i + d - 4) END GROUP BY 1, 2),
high AS (SELECT id, 32 + o.i AS pos, sum(hi * v) AS v FROM o CROSS JOIN taps JOIN sig ON sig.pos = CASE WHEN abs(2 * o.i + d - 3) > 63 THEN 126 - abs(2 * o.i + d - 3) ELSE abs(2 * o.i + d - 3) END GROUP BY 1, 2)
SELECT id, CAST(pos AS BIGINT) AS pos, {sql_r6('v', 5)} AS v FROM (SELECT * FROM low UNION ALL SELECT * FROM high)""",
)
def _(spark, d):
    rows = X.signals(spark, d).select("id", wavelet.dwt_direct(F.col("vals")).alias("vals"))
    return D.to_long(rows, ["id"], "pos").withColumn("v", r6("v", 5))


@query("t02_symmetric_extension", "WITH p AS (SELECT n, i.range - 4 AS i FROM (VALUES (2), (4), (8), (64)) t(n), range(73) i WHERE i.range < n + 9), m AS (SELECT n, i, ((i % (2 * (n - 1))) + 2 * (n - 1)) % (2 * (n - 1)) AS j FROM p) SELECT CAST(n AS BIGINT) AS n, CAST(i AS BIGINT) AS i, CAST(least(j, 2 * (n - 1) - j) AS BIGINT) AS place FROM m")
def _(spark, d):
    grid = spark.createDataFrame([(n,) for n in (2, 4, 8, 64)], "n long").select("n", F.explode(F.sequence(F.lit(-4).cast("long"), F.col("n") + 4)).alias("i"))
    period = 2 * (F.col("n") - 1)
    j = F.pmod(F.col("i"), period)
    return grid.select("n", "i", F.least(j, period - j).alias("place"))


@query("t04_direct_inverse", f"WITH {SIG} SELECT id, CAST(pos AS BIGINT) AS pos, {sql_r6('v', 5)} AS v FROM sig")
def _(spark, d):
    rows = X.signals(spark, d).select("id", wavelet.idwt_direct(wavelet.dwt_direct(F.col("vals"))).alias("vals"))
    return D.to_long(rows, ["id"], "pos").withColumn("v", r6("v", 5))


@query("t06_lifting_inverse", f"WITH {E} SELECT region, rank, step, {sql_r6('v')} AS v FROM effort")
def _(spark, d):
    return long6(effort_rows(spark, d).withColumn("vals", wavelet.idwt(wavelet.dwt(F.col("vals"), 1), 1)), ["region", "rank"])


@query("t07_multilevel_forward", f"WITH {SIG}, {SIG1}, {sql_levels('t', 's', 'id', 'pos', 64, 6)} SELECT id, pos, {sql_r6('v')} AS v FROM t")
def _(spark, d):
    return long6(X.signals(spark, d).select("id", wavelet.dwt(F.col("vals")).alias("vals")), ["id"], "pos")


@query("t08_partial_inverse", f"WITH {SIG}, {SIG1}, {sql_levels('t', 's', 'id', 'pos', 64, 2)} SELECT id, pos, {sql_r6('v')} AS v FROM t")
def _(spark, d):
    rows = X.signals(spark, d).select("id", wavelet.idwt(wavelet.dwt(F.col("vals"), 5), 5, 3).alias("vals"))
    return long6(rows, ["id"], "pos")


@query("t09_t11_pyramid_2d", f"WITH {E}, {sql_levels2('t', 'effort', 'region', 16, 64, 3)} SELECT region, rank, step, {sql_r6('v')} AS v FROM t")
def _(spark, d):
    return long6(wavelet.dwt2(effort_rows(spark, d), ["region"], 3, SHAPE), ["region", "rank"])


@query("t12_distributed_pyramid", f"WITH {E}, {sql_levels2('t', 'effort', 'region', 16, 64, 3)} SELECT region, rank, step, {sql_r6('v')} AS v FROM t")
def _(spark, d):
    return long6(wavelet.dwt2_large(effort_rows(spark, d), ["region"], 3, SHAPE), ["region", "rank"])


@query("t12_distributed_inverse", f"WITH {E} SELECT region, rank, step, {sql_r6('v')} AS v FROM effort")
def _(spark, d):
    made = wavelet.dwt2_large(effort_rows(spark, d), ["region"], 2, SHAPE)
    return long6(wavelet.idwt2_large(made, ["region"], 2, SHAPE), ["region", "rank"])


@query("t10_inverse_2d", f"WITH {E} SELECT region, rank, step, {sql_r6('v')} AS v FROM effort")
def _(spark, d):
    return long6(wavelet.dwt2(wavelet.dwt2(effort_rows(spark, d), ["region"], 4, SHAPE), ["region"], 4, SHAPE, 4), ["region", "rank"])


@query("t16_reassemble_rows", "WITH r AS (SELECT range AS i, range // 8 AS b, range % 8 AS o FROM range(32)) SELECT CAST(i AS BIGINT) AS row, CAST(CASE WHEN o >= 4 THEN 16 + b * 4 + o - 4 WHEN o >= 2 THEN 8 + b * 2 + o - 2 ELSE b * 2 + o END AS BIGINT) AS place FROM r")
def _(spark, d):
    return spark.range(32).select(F.col("id").alias("row"), wavelet.reassembled_row("id", 4, 8, 2).alias("place"))


@query("t17_signature", f"WITH {SIG}, {SIG1}, {sql_levels('t', 's', 'id', 'pos', 64, 2)} SELECT id, pos, {sql_r6('v')} AS v FROM t WHERE pos < 16")
def _(spark, d):
    return long6(X.signals(spark, d).select("id", wavelet.signature(F.col("vals"), 64).alias("vals")), ["id"], "pos")


@query("t18_low_bands", f"WITH {E}, {sql_levels2('t', 'effort', 'region', 16, 64, 3)} SELECT region, rank, step, {sql_r6('v')} AS v FROM t WHERE rank < 4 AND step < 16")
def _(spark, d):
    cells = D.to_long(wavelet.dwt2(effort_rows(spark, d), ["region"], 3, SHAPE), ["region", "rank"])
    return wavelet.low_bands(cells, 16, 64, 3, 1).withColumn("v", r6("v"))


@query("t19_s04_approximation", f"WITH {E}, {sql_levels2('t', 'effort', 'region', 16, 64, 2)} SELECT region, rank, step, {sql_r6('v * 4')} AS v FROM t WHERE rank < 4 AND step < 16")
def _(spark, d):
    cells = D.to_long(wavelet.dwt2(effort_rows(spark, d), ["region"], 3, SHAPE), ["region", "rank"])
    low = D.to_rows(wavelet.low_bands(cells, 16, 64, 3, 1), ["region", "rank"])
    return D.to_long(wavelet.dwt2(low, ["region"], 1, (4, 16), 1), ["region", "rank"]).withColumn("v", r6(F.col("v") * 4))


Q_SQL = f"{E}, {sql_levels2('t', 'effort', 'region', 16, 64, 3)}, q AS (SELECT region, rank, step, CAST(round(round(v, 6) * 16) AS BIGINT) AS q FROM t)"
C_SQL = f"{Q_SQL}, mq AS (SELECT region, CAST(round(avg(q)) AS BIGINT) AS mean FROM q GROUP BY 1), c AS (SELECT q.region, rank, step, q - mean AS q, mean FROM q JOIN mq USING (region)), th AS (SELECT region, CAST(1 AS BIGINT) << (length(bin(max(abs(q)))) - 1) AS threshold FROM c GROUP BY 1)"


def quantized(spark, d):
    cells = D.to_long(wavelet.dwt2(effort_rows(spark, d), ["region"], 3, SHAPE), ["region", "rank"])
    return cells.select("region", "rank", "step", codec.quantize(F.round("v", 6), 16).alias("q"))


def centered(spark, d):
    return codec.centered(quantized(spark, d), ["region"])


def truncated_sql(p: int) -> str:
    low, step = f"(threshold >> {p - 1})", f"(threshold >> {p})"
    return f"CASE WHEN {low} = 0 THEN q WHEN abs(q) < {low} THEN 0 WHEN {step} > 0 THEN sign(q) * (abs(q) - abs(q) % {step}) ELSE q END"


@query("c01_quantize", f"WITH {Q_SQL} SELECT region, rank, step, q FROM q")
def _(spark, d):
    return quantized(spark, d)


@query("c02_c03_mean_and_threshold", f"WITH {C_SQL} SELECT c.region, rank, step, q, mean, threshold FROM c JOIN th ON th.region = c.region")
def _(spark, d):
    return centered(spark, d)


@query("c04_level_resolve", "SELECT CAST(l AS BIGINT) AS level, CAST(CASE WHEN l < 1 THEN 4 ELSE least(l, 4) END AS BIGINT) AS resolved FROM (VALUES (-1), (0), (1), (3), (9)) t(l)")
def _(spark, d):
    return spark.createDataFrame([(x, codec.resolve_level(x, 16, 64)) for x in (-1, 0, 1, 3, 9)], "level long, resolved long")


@query("c05_o05_bitplane_truncation", f"WITH {C_SQL} SELECT c.region, rank, step, CAST({truncated_sql(5)} AS BIGINT) AS q FROM c JOIN th ON th.region = c.region")
def _(spark, d):
    return centered(spark, d).select("region", "rank", "step", codec.truncate_passes("q", "threshold", 5).alias("q"))


@query("c06_dequantize", f"WITH {C_SQL} SELECT c.region, rank, step, {sql_r6(f'({truncated_sql(4)} + mean) / 16.0')} AS v FROM c JOIN th ON th.region = c.region")
def _(spark, d):
    t = centered(spark, d).withColumn("q", codec.truncate_passes("q", "threshold", 4))
    return t.select("region", "rank", "step", r6(codec.dequantize("q", "mean", 16)).alias("v"))


def rate_sql() -> str:
    cases = " UNION ALL ".join(f"SELECT c.region, {p} AS passes, q, CAST({truncated_sql(p)} AS BIGINT) AS t FROM c JOIN th ON th.region = c.region" for p in range(1, 9))
    return f"WITH {C_SQL}, a AS ({cases}) SELECT region, passes, {sql_r6('sqrt(avg(CAST((q - t) * (q - t) AS DOUBLE))) / (max(q) - min(q))')} AS nrmse FROM a GROUP BY 1, 2"


@query("s21_rate_distortion", rate_sql())
def _(spark, d):
    c = centered(spark, d)
    each = c.select("region", "q", F.explode(F.array(*[F.struct(F.lit(p).alias("passes"), codec.truncate_passes("q", "threshold", p).alias("t")) for p in range(1, 9)])).alias("x"))
    diff = (F.col("q") - F.col("x.t")).cast("double")
    return each.groupBy("region", F.col("x.passes").alias("passes")).agg(r6(F.sqrt(F.avg(diff * diff)) / (F.max("q") - F.min("q"))).alias("nrmse"))


def tree_sql() -> str:
    """Level by level from the leaves: a cell's bits and those of its four children."""
    bit = "CASE WHEN q = 0 THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) << (length(bin(abs(q))) - 1) END"
    parent = "CASE WHEN rank < 2 AND step < 8 THEN -1 WHEN rank < 4 AND step < 16 THEN rank % 2 ELSE rank // 2 END AS pr, CASE WHEN rank < 2 AND step < 8 THEN -1 WHEN rank < 4 AND step < 16 THEN step % 8 ELSE step // 2 END AS pc"
    out = f"z0 AS (SELECT region, rank, step, q, {bit} AS tree, {parent} FROM c)"
    for k in range(3):
        out += f", z{k + 1} AS (SELECT z.region, z.rank, z.step, z.q, z.tree | coalesce(u.t, 0) AS tree, z.pr, z.pc FROM z{k} z LEFT JOIN (SELECT region, pr, pc, bit_or(tree) AS t FROM z{k} GROUP BY 1, 2, 3) u ON u.region = z.region AND u.pr = z.rank AND u.pc = z.step)"
    return out


@query("a27_c08_zerotree_map", f"WITH {C_SQL}, {tree_sql()} SELECT region, rank, step, tree FROM z3")
def _(spark, d):
    return codec.zerotree(centered(spark, d), ["region"], 16, 64, 3).select("region", "rank", "step", "tree")


SYMBOL_SQL = "CASE WHEN abs(q) >= s AND abs(q) < 2 * s THEN CASE WHEN q > 0 THEN 'P' ELSE 'N' END WHEN tree & s = 0 THEN 'T' ELSE 'Z' END"


@query("c07_dominant_symbols", f"WITH {C_SQL}, {tree_sql()}, y AS (SELECT z3.region, p.range AS pass, {SYMBOL_SQL} AS symbol FROM (SELECT z.*, threshold, p.range, threshold >> p.range AS s FROM z3 z JOIN th ON th.region = z.region, range(4) p) z3, range(4) p WHERE p.range = z3.range) SELECT region, CAST(pass AS INTEGER) AS pass, symbol, count(*) AS n FROM y GROUP BY 1, 2, 3")
def _(spark, d):
    tree = codec.zerotree(centered(spark, d), ["region"], 16, 64, 3)
    each = tree.withColumn("pass", F.explode(F.array(*map(F.lit, range(4)))))
    symbol = codec.dominant_symbol("q", "tree", F.call_function("shiftright", F.col("threshold"), F.col("pass")))
    return each.groupBy("region", "pass", symbol.alias("symbol")).agg(F.count("*").alias("n"))


#: Preorder by the root, the band and the quadrants on the way down, from each cell's place alone.
VISIT_SQL = """WITH c AS (SELECT r.range AS rank, c.range AS step, CASE WHEN r.range < 2 AND c.range < 8 THEN 0 WHEN r.range < 4 AND c.range < 16 THEN 1 WHEN r.range < 8 AND c.range < 32 THEN 2 ELSE 3 END AS d FROM range(16) r, range(64) c),
t AS (SELECT *, rank >> greatest(d - 1, 0) AS tr, step >> greatest(d - 1, 0) AS tc FROM c),
w AS (SELECT *, (tr % 2) * 8 + tc % 8 AS root, CASE WHEN d = 0 THEN 0 ELSE 2 * CAST(tr >= 2 AS INTEGER) + CAST(tc >= 8 AS INTEGER) END AS band,
   CASE WHEN d > 1 THEN CAST(2 * ((rank >> (d - 2)) & 1) + ((step >> (d - 2)) & 1) AS VARCHAR) ELSE '' END || CASE WHEN d > 2 THEN CAST(2 * (rank & 1) + (step & 1) AS VARCHAR) ELSE '' END AS path FROM t)
SELECT row_number() OVER (ORDER BY root, band, path) - 1 AS visit, rank, step, CAST(CASE d WHEN 0 THEN 64 WHEN 1 THEN 21 WHEN 2 THEN 5 ELSE 1 END AS BIGINT) AS below FROM w"""


@query("c09_traversal_order", VISIT_SQL)
def _(spark, d):
    tree = codec.Tree(*SHAPE, 3)
    rows = [(i, int(at) // 64, int(at) % 64, int(end) - i) for i, (at, end) in enumerate(zip(tree.at, tree.end, strict=True))]
    return spark.createDataFrame(rows, "visit long, rank long, step long, below long")


@query("c10_refinement_bits", f"WITH {C_SQL} SELECT c.region, count(*) FILTER (abs(q) >= threshold >> 2) AS significant, CAST(sum(CASE WHEN abs(q) >= threshold >> 2 THEN (abs(q) >> (length(bin(threshold)) - 4)) & 1 ELSE 0 END) AS BIGINT) AS ones FROM c JOIN th ON th.region = c.region GROUP BY 1")
def _(spark, d):
    c = centered(spark, d).where(F.abs("q") >= F.call_function("shiftright", F.col("threshold"), F.lit(2)))
    bit = F.call_function("shiftright", F.abs("q"), F.length(F.bin("threshold")) - 4).bitwiseAND(F.lit(1))
    return c.groupBy("region").agg(F.count("*").alias("significant"), F.sum(bit).alias("ones"))


def coded_sql(level: int = 3) -> str:
    return f"{E}, {sql_levels2('t', 'effort', 'region', 16, 64, level)}, q AS (SELECT region, rank, step, CAST(round(v * 16) AS BIGINT) AS q FROM t), mq AS (SELECT region, CAST(round(avg(q)) AS BIGINT) AS mean FROM q GROUP BY 1), c AS (SELECT q.region, rank, step, q - mean AS q, mean FROM q JOIN mq USING (region)), th AS (SELECT region, CASE WHEN max(abs(q)) = 0 THEN 0 ELSE CAST(1 AS BIGINT) << (length(bin(max(abs(q)))) - 1) END AS threshold FROM c GROUP BY 1)"


#: Bits of each pass: a cell is visited in the low band, right below it, or under a parent with the pass's bit at or below it.
PASS_SQL = f"""{coded_sql()}, {tree_sql()},
ab AS (SELECT z.region, z.rank, z.step, z.q, u.tree AS above FROM z3 z LEFT JOIN z3 u ON u.region = z.region AND u.rank = z.pr AND u.step = z.pc),
pt AS (SELECT ab.*, CAST(k.range AS INTEGER) AS pass, threshold >> k.range AS t FROM ab JOIN th USING (region) JOIN range(48) k ON threshold >> k.range > 0),
passes AS (SELECT region, pass, 2 * count(*) FILTER ((rank < 4 AND step < 16) OR above & t <> 0) AS dominant, CASE WHEN t > 1 THEN count(*) FILTER (abs(q) >= t) ELSE 0 END AS subordinate FROM pt GROUP BY region, pass, t)"""


def coded(spark, d, **settings):
    return effortlog.compress(effort_rows(spark, d), ["region"], SHAPE, **{"level": 3, "scale": 16} | settings)


def cells(rows, value):
    return rows.select("region", "rank", F.posexplode("vals").alias("step", "x"), "mean").select("region", "rank", F.col("step").cast("long").alias("step"), value.alias("q"))


@query("c11_pass_sizes", f"WITH {PASS_SQL} SELECT region, pass, CAST(dominant AS BIGINT) AS dominant, CAST(subordinate AS BIGINT) AS subordinate FROM passes")
def _(spark, d):
    return coded(spark, d).select("region", F.posexplode(F.arrays_zip("dominant", "subordinate")).alias("pass", "b")).select("region", "pass", "b.dominant", "b.subordinate")


def payload_sql(limit: int = 99) -> str:
    return f"WITH {PASS_SQL} SELECT region, count(*) AS passes, CAST(ceil(sum(dominant + subordinate) / 8.0) AS BIGINT) AS ezw_size, CAST(0 AS BIGINT) AS worst FROM passes WHERE pass < {limit} GROUP BY 1"


def payload_facts(spark, d, encoding: str, passes: int = 0):
    """A payload's passes and bytes, and its worst difference from the values that so many passes give."""
    made = checkpointed(coded(spark, d, encoding=encoding, passes=passes))
    back = effortlog.coefficients(made, ["region"]).select("region", "rank", F.col("vals").alias("back"))
    want = effortlog.quantized(effort_rows(spark, d), ["region"], SHAPE, 3, 16)
    want = want.select("region", "rank", F.transform("vals", lambda q: codec.truncate_passes(q, F.col("threshold"), passes)).alias("want"))
    off = F.array_max(F.zip_with("back", "want", lambda a, b: F.abs(a - b))).cast("long")
    worst = back.join(want, ["region", "rank"], "full").groupBy("region").agg(F.max(F.coalesce(off, F.lit(2**62))).alias("worst"))
    return made.select("region", "passes", "ezw_size").join(worst, "region")


@query("c12_c17_encode_huffman", payload_sql())
def _(spark, d):
    return payload_facts(spark, d, "huffman")


@query("c18_c19_encode_arithmetic", payload_sql(3))
def _(spark, d):
    return payload_facts(spark, d, "arithmetic", 3)


@query("c13_c14_encode_rle", payload_sql(5))
def _(spark, d):
    return payload_facts(spark, d, "rle", 5)


@query("c21_byte_budget", f"WITH {PASS_SQL}, u AS (SELECT region, pass, sum(dominant + subordinate) OVER (PARTITION BY region ORDER BY pass) AS bits FROM passes) SELECT region, count(*) AS passes, CAST(max(ceil(bits / 8.0)) AS BIGINT) AS bytes FROM u WHERE bits <= 8 * 600 GROUP BY 1")
def _(spark, d):
    each = coded(spark, d).select("region", F.posexplode(F.arrays_zip("dominant", "subordinate")).alias("pass", "b"))
    bits = F.sum(F.col("b.dominant") + F.col("b.subordinate")).over(Window.partitionBy("region").orderBy("pass"))
    fits = each.select("region", "pass", bits.alias("bits")).where("bits <= 8 * 600")
    return fits.groupBy("region").agg(F.count("*").alias("passes"), F.max(F.ceil(F.col("bits") / 8)).alias("bytes"))


@query("c25_sizes_and_ratio", f"WITH {PASS_SQL}, z AS (SELECT region, CAST(ceil(sum(dominant + subordinate) / 8.0) AS BIGINT) AS ezw_size FROM passes GROUP BY 1) SELECT region, CAST(8192 AS BIGINT) AS raw, ezw_size, {sql_r6('8192.0 / ezw_size')} AS ratio FROM z")
def _(spark, d):
    raw = F.col("rows") * F.col("cols") * 8
    return coded(spark, d).select("region", raw.alias("raw"), "ezw_size", r6(raw / F.col("ezw_size")).alias("ratio"))


@query("c22_c24_block_encode", f"WITH {coded_sql(2)} SELECT region, rank, step, q FROM q")
def _(spark, d):
    made = coded(spark, d, level=2, blocks=4)
    return cells(effortlog.coefficients(made, ["region"]), F.col("x") + F.col("mean"))


@query("c26_c27_log_round_trip", f"WITH {coded_sql()} SELECT region, rank, step, q FROM q")
def _(spark, d):
    path = scratch(spark)
    effortlog.write_log(coded(spark, d, blocks=2, encoding="arithmetic"), path)
    return cells(effortlog.coefficients(effortlog.read_log(spark, path), ["region"]), F.col("x") + F.col("mean"))


@query("c26_reconstruct", f"WITH {E} SELECT region, rank, TRUE AS near FROM effort GROUP BY 1, 2")
def _(spark, d):
    rows = effort_rows(spark, d)
    back = effortlog.reconstruct(coded(spark, d, blocks=2), ["region"]).withColumnRenamed("vals", "back")
    off = F.array_max(F.zip_with("vals", "back", lambda a, b: F.abs(a - b)))
    return rows.join(back, ["region", "rank"], "left").select("region", "rank", F.coalesce(off < 0.25, F.lit(False)).alias("near"))  # four steps of the scale


@query("s21_decode_passes", f"WITH {coded_sql()} SELECT c.region, rank, step, CAST({truncated_sql(5)} AS BIGINT) AS q FROM c JOIN th ON th.region = c.region")
def _(spark, d):
    return cells(effortlog.coefficients(coded(spark, d), ["region"], limit=5), F.col("x"))


@query("s21_partial_inverse", f"WITH {E}, {sql_levels2('t', 'effort', 'region', 16, 64, 1)} SELECT region, count(*) AS cells, TRUE AS near FROM t GROUP BY 1")
def _(spark, d):
    back = D.to_long(effortlog.reconstruct(coded(spark, d), ["region"], undo=2), ["region", "rank"])
    want = D.to_long(wavelet.dwt2(effort_rows(spark, d), ["region"], 1, SHAPE), ["region", "rank"]).withColumnRenamed("v", "w")
    return back.join(want, ["region", "rank", "step"]).groupBy("region").agg(F.count("*").alias("cells"), (F.max(F.abs(F.col("v") - F.col("w"))) < 0.25).alias("near"))


@query("c25_log_of_4096")
def _(spark, d):
    """The size that is published: 4096 processes, 256 steps, level 7, scale 1024, 5 passes, 8 blocks; of a synthetic log."""
    from loadlens.sources.synthetic import synthetic_log

    rows = D.to_rows(synthetic_log(spark, 4096, 256, 1).drop("k").withColumn("region", F.lit("synthetic")), ["region", "rank"])
    made = effortlog.compress(rows, ["region"], (4096, 256), 7, 1024, 5, 8)
    return made.select("region", "passes", "ezw_size", "rle_size", "enc_size", r6(F.col("rows") * F.col("cols") * 8 / F.col("enc_size"), 2).alias("ratio"))


@query("a19_k01_coefficient_rmse", f"WITH {E}, {sql_levels2('t', 'effort', 'region', 16, 64, 3)} SELECT a.region AS a, b.region AS b, {sql_r6('sqrt(avg(pow(a.v - b.v, 2)))')} AS wtrmse FROM t a JOIN t b ON a.rank = b.rank AND a.step = b.step AND a.region < b.region GROUP BY 1, 2")
def _(spark, d):
    db = RegionDB(X.effort(spark, d).withColumn("metric", F.lit("value")), SHAPE)
    return db.distances("value", level=3).select("a", "b", r6("rmse").alias("wtrmse"))


@query("t13_level_matrix_product", f"WITH {SIG}, {SIG1}, {sql_levels('t', 's', 'id', 'pos', 64, 2)} SELECT id, pos, {sql_r6('v')} AS v FROM t")
def _(spark, d):
    m = wavelet.level_matrix(64, 2)
    entries = [(int(i), int(j), float(m[i, j])) for i, j in zip(*m.nonzero(), strict=True)]
    matrix = spark.createDataFrame(entries, "out long, pos long, w double")
    long = D.to_long(X.signals(spark, d).select("id", "vals"), ["id"], "pos")
    return long.join(F.broadcast(matrix), "pos").groupBy("id", F.col("out").alias("pos")).agg(r6(F.sum(F.col("w") * F.col("v"))).alias("v"))  # a fixed table


# ---- similarity and clustering ----

SMOOTH = "smooth AS (SELECT region, rank, step, round(avg(v) OVER (PARTITION BY region, rank ORDER BY step ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS v FROM effort)"
BAND_SQL = """CASE WHEN rank < 8 AND step < 32 THEN (CASE WHEN rank < 4 AND step < 16 THEN 'LL2' WHEN rank < 4 THEN 'HL2' WHEN step < 16 THEN 'LH2' ELSE 'HH2' END)
 WHEN rank < 8 THEN 'HL1' WHEN step < 32 THEN 'LH1' ELSE 'HH1' END"""
BOX = 3
SSIM_SQL = f"""{E}, {SMOOTH}, {sql_levels2('t', 'effort', 'region', 16, 64, 2)}, {sql_levels2('u', 'smooth', 'region', 16, 64, 2)},
p AS (SELECT t.region, t.rank, t.step, {BAND_SQL.replace('rank', 't.rank').replace('step', 't.step')} AS band, round(t.v, 6) AS x, round(u.v, 6) AS y FROM t JOIN u USING (region, rank, step)),
h AS (SELECT *, sum(x * y) OVER w AS xy, sum(x * x) OVER w AS xx, sum(y * y) OVER w AS yy, row_number() OVER (PARTITION BY region, band, rank ORDER BY step) AS i FROM p WINDOW w AS (PARTITION BY region, band, rank ORDER BY step ROWS BETWEEN {BOX - 1} PRECEDING AND CURRENT ROW)),
g AS (SELECT region, band, i, sum(xy) OVER w AS xy, sum(xx) OVER w AS xx, sum(yy) OVER w AS yy, row_number() OVER (PARTITION BY region, band, step ORDER BY rank) AS j FROM h WINDOW w AS (PARTITION BY region, band, step ORDER BY rank ROWS BETWEEN {BOX - 1} PRECEDING AND CURRENT ROW)),
bands AS (SELECT region, band, avg((2 * abs(xy) + 0.01) / (xx + yy + 0.01)) AS similarity FROM g WHERE i >= {BOX} AND j >= {BOX} GROUP BY 1, 2)"""


def bands(spark, d):
    from loadlens.plans.aggregates import smoothed

    long = X.effort(spark, d)
    two = [D.to_long(wavelet.dwt2(D.to_rows(x, ["region", "rank"]), ["region"], 2, SHAPE), ["region", "rank"]).withColumn("v", F.round("v", 6)) for x in (long, smoothed(long))]
    cells = two[0].withColumnRenamed("v", "x").join(two[1].withColumnRenamed("v", "y"), ["region", "rank", "step"])
    return ssim.band_similarity(cells, ["region"], 16, 64, 2, BOX)


@query("w02_f13_band_similarity", f"WITH {SSIM_SQL} SELECT region, band, {sql_r6('similarity', 5)} AS similarity FROM bands")
def _(spark, d):
    return bands(spark, d).withColumn("similarity", r6("similarity", 5))


@query("k11_wssim", f"WITH {SSIM_SQL}, l AS (SELECT region, CASE WHEN band LIKE 'LL%' THEN 'LL' ELSE substr(band, 3) END AS l, avg(similarity) AS s FROM bands GROUP BY 1, 2) SELECT region, {sql_r6('avg(s)', 5)} AS wssim FROM l GROUP BY 1")
def _(spark, d):
    return ssim.wssim(bands(spark, d), ["region"]).withColumn("wssim", r6("wssim", 5))


SIG16 = f"{SIG}, {SIG1}, {sql_levels('t', 's', 'id', 'pos', 64, 2)}, g AS (SELECT id, pos, round(v, 6) AS v FROM t WHERE pos < 16)"


def signatures(spark, d):
    vals = F.transform(wavelet.signature(F.col("vals"), 64), lambda x: F.round(x, 6))
    return X.signals(spark, d).select("id", vals.alias("vals"), "label")


@query("f06_f08_k04_signature_pairs", f"WITH {SIG16} SELECT a.id AS a, b.id AS b, {sql_r6('sqrt(sum(pow(a.v - b.v, 2)))')} AS euclidean, {sql_r6('sum(abs(a.v - b.v))')} AS manhattan FROM g a JOIN g b ON a.pos = b.pos AND a.id < b.id GROUP BY 1, 2")
def _(spark, d):
    return cluster.pair_distances(signatures(spark, d), ["euclidean", "manhattan"], digits=6)


@query("j07_nearest_medoid", f"WITH {SIG16}, d AS (SELECT p.id, m.id AS medoid, sqrt(sum(pow(p.v - m.v, 2))) AS d FROM g p JOIN g m ON p.pos = m.pos WHERE m.id IN (0, 50, 100, 150) GROUP BY 1, 2) SELECT id, arg_min(medoid, round(d, 9) * 1000000 + medoid / 1000.0) AS medoid, {sql_r6('min(d)', 5)} AS d FROM d GROUP BY 1")
def _(spark, d):
    s = signatures(spark, d)
    return cluster.assign(s, s.where("id in (0, 50, 100, 150)")).withColumn("d", r6("d", 5))


@query("k08_mirkin", "WITH c AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS n, CAST((SELECT sum(s * s) FROM (SELECT sum(n) AS s FROM c GROUP BY a)) + (SELECT sum(s * s) FROM (SELECT sum(n) AS s FROM c GROUP BY b)) - 2 * sum(n * n) AS BIGINT) AS distance FROM c")
def _(spark, d):
    e = X.table(spark, d, "embeddings").withColumn("other", F.col("vec_id") % 10)
    return cluster.mirkin(e, "label", "other").select("n", "distance")


@query("k09_cluster_expansion", "SELECT CAST(vec_id * 4 + o.range AS BIGINT) AS id, label AS cluster FROM embeddings, range(4) o")
def _(spark, d):
    return cluster.expand(X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")), 2)


@query("k02_k03_complete_linkage")
def _(spark, d):
    regions = D.to_rows(X.effort(spark, d).withColumn("at", F.col("rank") * 64 + F.col("step")), ["region"], "at").select(F.col("region").alias("id"), "vals")
    ids, dist = cluster.matrix_of(regions)
    merges = cluster.complete_linkage(ids, dist)
    return spark.createDataFrame(merges, "step long, left long, right long, height double, size long")


@query("o07_flatten_clusters")
def _(spark, d):
    return spark.createDataFrame(allpoints.linked(spark, signatures(spark, d), 10), "id long, cluster long")


@query("k05_pam")
def _(spark, d):
    s = signatures(spark, d)
    return cluster.assign(s, s.where(F.col("id").isin(allpoints.pam(spark, s, 10))))


@query("k06_xpam_bic")
def _(spark, d):
    medoids, score = allpoints.xpam(spark, signatures(spark, d), 12)
    return spark.createDataFrame([(m, score) for m in medoids], "medoid long, bic double")


@query("k07_clara")
def _(spark, d):
    return cluster.clara(spark, signatures(spark, d), 10)


Z95 = S.confidence_z(0.95)


def strata_size_sql(name: str, by: str) -> str:
    size = f"CAST(round(n / (1 + n * pow(0.08 * (s / n) / ({Z95} * greatest(sqrt(greatest(s2 / n - (s / n) * (s / n), 0)), 1e-9)), 2))) AS BIGINT)"
    return f"{name} AS (SELECT stratum, max(n) AS size, greatest(max({size}), 1) AS sample FROM (SELECT {by} AS stratum, region, sum(v) AS s, sum(v * v) AS s2, count(*) AS n FROM pv GROUP BY 1, 2) GROUP BY 1)"


STRATA_SQL = f"""{E}, wd AS (SELECT * FROM effort WHERE step >= 16 AND step < 32), tr AS (SELECT rank, step, v FROM wd WHERE region = (SELECT min(region) FROM effort)),
ds AS (SELECT p.rank, m.rank AS medoid, sqrt(sum(pow(p.v - m.v, 2))) AS d FROM tr p JOIN tr m USING (step) WHERE m.rank IN (0, 5, 10, 15) GROUP BY 1, 2),
sm AS (SELECT rank, arg_min(medoid, round(d, 9) * 1000000 + medoid / 1000.0) AS stratum FROM ds GROUP BY 1), pv AS (SELECT region, rank, stratum, sum(v) AS v FROM wd JOIN sm USING (rank) GROUP BY 1, 2, 3),
{strata_size_sql("own", "stratum")}, {strata_size_sql("whole", "0")}"""


@query("k14_k15_strata", f"WITH {STRATA_SQL} SELECT own.stratum, own.size, own.sample, {sql_r6('own.sample / own.size')} AS proportion, CAST((SELECT sum(sample) FROM own) AS BIGINT) AS stratified, whole.sample AS global, (SELECT sum(sample) FROM own) < whole.sample AS good FROM own, whole")
def _(spark, d):
    window = X.effort(spark, d).where("step >= 16 and step < 32")  # the trailing window of an update
    first = window.agg(F.min("region").alias("region"))
    traces = D.to_rows(window.join(F.broadcast(first), "region"), ["rank"]).withColumnRenamed("rank", "id")  # a row
    strata = cluster.assign(traces, traces.where("id in (0, 5, 10, 15)")).select(F.col("id").alias("rank"), F.col("medoid").alias("stratum"))
    per = window.groupBy("region", "rank").agg(F.sum("v").alias("v")).join(strata, "rank")
    own = sampling.proportions(per, ["region"], ["stratum"], 0.95, 0.08)
    whole = sampling.proportions(per.withColumn("stratum", F.lit(0)), ["region"], ["stratum"], 0.95, 0.08)
    judged = sampling.stratified_is_better(own, whole)
    return own.withColumn("proportion", r6("proportion")).crossJoin(F.broadcast(judged))  # a row


@query("k12_process_sampling", "SELECT rank, u, (rank * 7919 + u * 104729) % 1000 / 1000.0 < 0.3 AS enabled FROM (SELECT r.range AS rank, u.range AS u FROM range(64) r, range(8) u)")
def _(spark, d):
    from loadlens.operators.sampling import enabled

    return spark.range(512).select(F.expr("id div 8").alias("rank"), F.expr("id % 8").alias("u")).withColumn("enabled", enabled("rank", "u", 0.3))
