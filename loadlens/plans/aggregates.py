"""Queries of aggregates, filters, joins, orders and sets over the effort tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loadlens.functions import scalars as S
from loadlens.operators import densify as D
from loadlens.operators import sampling, stats
from loadlens.operators.checkpoints import numbered
from loadlens.plans.catalog import query, r6, sql_r6
from loadlens.sources import fixtures as X
from loadlens.sources.regiondb import RegionDB

E, P, SHIP, SIG = X.EFFORT_SQL, X.PATHS_SQL, X.SHIPMENTS_SQL, X.SIGNALS_SQL

ROW_MOMENTS = """rm AS (SELECT region, rank, count(*) AS n, avg(v) AS m FROM effort GROUP BY 1, 2),
rv AS (SELECT e.region, e.rank, any_value(n) AS n, sum(pow(v - m, 2)) / (any_value(n) - 1) AS var, sum(pow(v - m, 3)) AS d3, sum(pow(v - m, 4)) AS d4 FROM effort e JOIN rm USING (region, rank) GROUP BY 1, 2),
rs AS (SELECT region, rank, var AS variance, CASE WHEN var > 1e-12 THEN d3 / ((n - 1) * pow(var, 1.5)) END AS skew, CASE WHEN var > 1e-12 THEN d4 / ((n - 1) * var * var) END AS kurtosis FROM rv)"""


@query("a01_keyed_accumulation", f"WITH {E} SELECT region, rank, step, v FROM fact")
def _(spark, d):
    return X.event_facts(spark, d)


@query("j05_densify", f"WITH {E} SELECT * FROM effort")
def _(spark, d):
    return X.effort(spark, d)


@query("t14_rows_as_arrays", f"WITH {E} SELECT region, rank, list(v ORDER BY step) AS vals FROM effort WHERE EXISTS (SELECT 1 FROM fact WHERE fact.region = effort.region AND fact.rank = effort.rank) GROUP BY region, rank")
def _(spark, d):
    return D.sparse_to_rows(X.event_facts(spark, d), ["region", "rank"], X.STEPS)


@query("a02_step_commit", f"WITH {E} SELECT region, rank, step, v, round(sum(v) OVER (PARTITION BY region, rank ORDER BY step), 4) AS upto FROM effort")
def _(spark, d):
    w = Window.partitionBy("region", "rank").orderBy("step")
    return X.effort(spark, d).withColumn("upto", F.round(F.sum("v").over(w), 4))


@query("a03_step_sampling", f"WITH {E} SELECT region, rank, step // 4 AS step, {sql_r6('sum(v)', 4)} AS v FROM effort GROUP BY region, rank, step // 4")
def _(spark, d):
    return X.effort(spark, d).withColumn("step", F.expr("step div 4")).groupBy("region", "rank", "step").agg(r6(F.sum("v"), 4).alias("v"))


@query(
    "a04_a07_range_aggregates",
    f"WITH {E} SELECT region, {sql_r6('sum(v)', 4)} AS total, {sql_r6('avg(v)')} AS mean, coalesce(max(v), 0) AS hi, coalesce(min(v), 0) AS lo, coalesce(max(abs(v)), 0) AS top FROM effort WHERE rank >= 2 AND rank < 11 AND step >= 5 AND step < 41 GROUP BY region",
)
def _(spark, d):
    part = X.effort(spark, d).where("rank >= 2 and rank < 11 and step >= 5 and step < 41")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return part.groupBy("region").agg(r6(F.sum("v"), 4).alias("total"), r6(F.avg("v")).alias("mean"), zero(F.max("v")).alias("hi"), zero(F.min("v")).alias("lo"), zero(F.max(F.abs("v"))).alias("top"))


@query(
    "a08_a13_region_summary",
    f"""WITH {E}, {ROW_MOMENTS},
w AS (SELECT region, sum(v) AS total, count(*) AS count, max(v) AS max, min(v) AS min, max(abs(v)) AS abs_max FROM effort GROUP BY 1),
m AS (SELECT region, avg(variance) AS mean_variance, max(variance) AS max_variance, min(variance) AS min_variance, avg(skew) AS mean_skew, max(skew) AS max_skew, min(skew) AS min_skew, avg(kurtosis) AS mean_kurtosis, max(kurtosis) AS max_kurtosis, min(kurtosis) AS min_kurtosis FROM rs GROUP BY 1)
SELECT region, {sql_r6('total', 4)} AS total, count, max, min, abs_max, {', '.join(f'{sql_r6(c)} AS {c}' for c in ('mean_variance', 'max_variance', 'min_variance', 'mean_skew', 'max_skew', 'min_skew', 'mean_kurtosis', 'max_kurtosis', 'min_kurtosis'))},
{sql_r6('total / count')} AS mean, {sql_r6('sqrt(mean_variance)')} AS mean_deviation, {sql_r6('sqrt(max_variance)')} AS max_deviation, {sql_r6('sqrt(min_variance)')} AS min_deviation FROM w JOIN m USING (region)""",
)
def region_summary(spark, d):
    out = stats.summary(X.effort(spark, d), ["region"])
    digits = {"total": 4} | {c: 6 for c in out.columns if c not in ("region", "count", "max", "min", "abs_max", "total")}
    return out.select("region", *[r6(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns if c != "region"])


@query("a09_a11_row_moments", f"WITH {E}, {ROW_MOMENTS} SELECT region, rank, {sql_r6('variance')} AS variance, {sql_r6('skew')} AS skew, {sql_r6('kurtosis')} AS kurtosis FROM rs")
def _(spark, d):
    return stats.row_moments(X.effort(spark, d), ["region"]).select("region", "rank", *[r6(c).alias(c) for c in ("variance", "skew", "kurtosis")])


SMOOTH_SQL = "smooth AS (SELECT region, rank, step, round(avg(v) OVER (PARTITION BY region, rank ORDER BY step ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS v FROM effort)"


def smoothed(long):
    w = Window.partitionBy("region", "rank").orderBy("step").rowsBetween(-1, 1)
    return long.withColumn("v", F.round(F.avg("v").over(w), 6))


@query(
    "a14_a19_k16_error_metrics",
    f"""WITH {E}, {SMOOTH_SQL}, s AS (SELECT e.region, sum(pow(e.v - s.v, 2)) AS squares, count(*) AS n, max(e.v) AS hi, min(e.v) AS lo, max(greatest(e.v, s.v)) AS hi2, min(least(e.v, s.v)) AS lo2, max(abs(e.v - s.v)) AS worst
FROM effort e JOIN smooth s USING (region, rank, step) GROUP BY 1)
SELECT region, {sql_r6('squares', 3)} AS squares, {sql_r6('worst')} AS worst, {sql_r6('sqrt(squares / n)')} AS rmse, {sql_r6('sqrt(squares / n) / (hi - lo)')} AS nrmse, {sql_r6('20 * log10((hi - lo) / sqrt(squares / n))')} AS psnr, {sql_r6('sqrt(squares / n) / (hi2 - lo2)')} AS similarity FROM s""",
)
def _(spark, d):
    long = X.effort(spark, d)
    out = stats.errors(long, smoothed(long), ["region"], ["rank", "step"])
    return out.select("region", r6("squares", 3).alias("squares"), *[r6(c).alias(c) for c in ("worst", "rmse", "nrmse", "psnr", "similarity")])


@query("a20_t20_standardize", f"WITH {E}, s AS (SELECT region, avg(v) AS m, stddev_pop(v) AS s FROM effort GROUP BY 1) SELECT region, rank, step, {sql_r6('CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END')} AS z FROM effort JOIN s USING (region)")
def _(spark, d):
    return stats.standardize(X.effort(spark, d), ["region"]).select("region", "rank", "step", r6("z").alias("z"))


@query("a21_mean_and_threshold", f"WITH {E}, q AS (SELECT region, CAST(round(v * 100) AS BIGINT) AS q FROM effort) SELECT region, CAST(round(avg(q)) AS BIGINT) AS mean, max(abs(q)) AS top, CASE WHEN max(abs(q)) = 0 THEN 0 ELSE 1 << (length(bin(max(abs(q)))) - 1) END AS threshold FROM q GROUP BY 1")
def _(spark, d):
    q = X.effort(spark, d).withColumn("q", F.round(F.col("v") * 100).cast("long"))
    return q.groupBy("region").agg(F.round(F.avg("q")).cast("long").alias("mean"), F.max(F.abs("q")).alias("top")).withColumn("threshold", S.le_power_of_2("top"))


Z95 = S.confidence_z(0.95)
SIZE_SQL = f"""st AS (SELECT region, rank, sum(CAST(v AS DECIMAL(18, 4))) AS v FROM effort GROUP BY 1, 2), ss AS (SELECT region, CAST(sum(v) AS DOUBLE) AS s, sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE)) AS s2, count(*) AS n FROM st GROUP BY 1),
sz AS (SELECT region, s, s2, n, s / n AS mean, greatest(s2 / n - (s / n) * (s / n), 0) AS variance, greatest(sqrt(greatest(s2 / n - (s / n) * (s / n), 0)), 1e-9) AS sd FROM ss),
sample AS (SELECT *, CAST(round(n / (1 + n * pow(0.08 * mean / ({Z95} * sd), 2))) AS BIGINT) AS size FROM sz)"""


def sampled(spark, d):
    # Facts have four digits, so decimals add up alike in any order.
    per = X.effort(spark, d).groupBy("region", "rank").agg(F.sum(F.col("v").cast("decimal(18,4)")).alias("v"))
    v = F.col("v").cast("double")
    sums = per.groupBy("region").agg(F.sum("v").cast("double").alias("s"), F.sum(v * v).alias("s2"), F.count("*").alias("n"))
    return sums.withColumn("mean", F.col("s") / F.col("n")).withColumn("size", S.sample_size("s", "s2", "n", 0.95, 0.08))


@query("a22_f11_sample_size", f"WITH {E}, {SIZE_SQL} SELECT region, mean, n, size FROM sample")
def _(spark, d):
    return sampled(spark, d).select("region", "mean", "n", "size")


@query("a23_k13_sample_proportion", f"WITH {E}, {SIZE_SQL} SELECT greatest(max(size), 1) AS sample, {sql_r6('greatest(max(size), 1) / 16.0')} AS proportion FROM sample")
def _(spark, d):
    most = F.greatest(F.max("size"), F.lit(1).cast("long"))
    return sampled(spark, d).agg(most.alias("sample"), r6(most / 16.0).alias("proportion"))


@query(
    "f12_sample_without_floor",
    f"WITH {E}, t AS (SELECT region, sum(v) AS s, sum(v * v) AS s2, 16 AS n FROM effort WHERE step = 3 GROUP BY 1), u AS (SELECT region, n, s / n AS m, sqrt(greatest(s2 / n - (s / n) * (s / n), 0)) AS sd FROM t) SELECT region, CASE WHEN sd > 0 THEN CAST(round(n / (1 + n * pow(0.1 * m / ({Z95} * sd), 2))) AS BIGINT) END AS size FROM u",
)
def _(spark, d):
    at = X.effort(spark, d).where("step = 3").groupBy("region").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.count("*").alias("n"))
    return at.select("region", S.sample_size("s", "s2", "n", 0.95, 0.1, floor=None).alias("size"))


@query(
    "a24_five_number_summary",
    f"WITH {SHIP}, o AS (SELECT metric, region, list(v ORDER BY v) AS l, avg(v) AS m FROM ship GROUP BY 1, 2) SELECT metric, region, CASE WHEN l[1] = 0 THEN 1.0 ELSE l[1] END AS low, l[len(l) // 4 + 1] AS q1, {sql_r6('m', 4)} AS mean, l[least(len(l) - len(l) // 4, len(l) - 1) + 1] AS q3, l[len(l)] AS high FROM o",
)
def _(spark, d):
    return stats.five_numbers(X.shipments(spark, d), ["metric", "region"]).withColumn("mean", r6("mean", 4))


@query("a25_type_histogram", "SELECT event_id % 3 AS type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return X.table(spark, d, "events").groupBy(F.expr("event_id % 3").alias("type")).agg(F.count("*").alias("n")).orderBy("type")


@query("a26_least_common_byte", "WITH b AS (SELECT CAST(floor(value) AS BIGINT) % 256 AS b, count(*) AS n FROM events GROUP BY 1) SELECT CAST(r.range AS BIGINT) AS byte, coalesce(n, 0) AS n FROM range(256) r LEFT JOIN b ON b.b = r.range ORDER BY coalesce(n, 0), r.range LIMIT 1")
def _(spark, d):
    counts = X.table(spark, d, "events").groupBy(F.expr("cast(floor(value) as bigint) % 256").alias("byte")).agg(F.count("*").alias("n"))
    every = spark.range(256).withColumnRenamed("id", "byte").join(counts, "byte", "left").select("byte", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return every.agg(F.min(F.struct("n", "byte")).alias("m")).select("m.byte", "m.n")


@query("a28_walk_error_rate", "SELECT 100.0 * sum(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) / count(*) AS percent FROM customer")
def _(spark, d):
    bad = F.exists("path", lambda f: f["module"] == "[unknown module]")
    return X.paths(spark, d).agg((100.0 * F.sum(bad.cast("int")) / F.count("*")).alias("percent"))


@query("a29_timer_merge", "WITH t AS (SELECT event_type AS name, min(event_id) AS first, CAST(sum(event_id) AS BIGINT) AS ns FROM events GROUP BY 1, user_id % 2) SELECT name, min(first) AS first, CAST(sum(ns) AS BIGINT) AS ns FROM t GROUP BY 1")
def _(spark, d):
    part = lambda k: X.table(spark, d, "events").where(f"user_id % 2 = {k}").groupBy(F.col("event_type").alias("name")).agg(F.min("event_id").alias("first"), F.sum("event_id").alias("ns"))
    return part(0).unionByName(part(1)).groupBy("name").agg(F.min("first").alias("first"), F.sum("ns").alias("ns")).orderBy("first")


@query(
    "a30_region_percent_of_run",
    f"WITH t AS (SELECT event_id % 3 AS type, event_type AS region, sum(value) AS v FROM events GROUP BY 1, 2) SELECT type, region, {sql_r6('sum(v) / 16', 4)} AS mean_total, {sql_r6('100 * sum(v) / (SELECT sum(v) FROM t)')} AS percent FROM t GROUP BY ROLLUP (type, region)",
)
def _(spark, d):
    t = X.table(spark, d, "events").groupBy(F.expr("event_id % 3").alias("type"), F.col("event_type").alias("region")).agg(F.sum("value").alias("v"))
    rolled = t.rollup("type", "region").agg(F.sum("v").alias("v"), F.grouping_id().alias("g"))
    whole = rolled.where("g = 3").select(F.col("v").alias("run"))
    return rolled.crossJoin(F.broadcast(whole)).select("type", "region", r6(F.col("v") / 16, 4).alias("mean_total"), r6(100 * F.col("v") / F.col("run")).alias("percent"))  # one row


@query("a31_surface_sum", f"WITH {E} SELECT rank, step, {sql_r6('sum(v)', 4)} AS v FROM effort WHERE region IN ('click', 'view') GROUP BY 1, 2")
def _(spark, d):
    return X.effort(spark, d).where("region in ('click', 'view')").groupBy("rank", "step").agg(r6(F.sum("v"), 4).alias("v"))


@query("a32_distinct_metrics", f"WITH {SHIP} SELECT metric, metric = 'time' AS first FROM (SELECT DISTINCT metric FROM ship UNION SELECT 'time')")
def _(spark, d):
    metrics = X.shipments(spark, d).select("metric").union(spark.createDataFrame([("time",)], "metric string")).distinct()
    return metrics.withColumn("first", F.col("metric") == "time").orderBy(F.col("metric") != "time", "metric")


BYTES_SQL = "b AS (SELECT user_id, ts, event_id, CAST(floor(value) AS BIGINT) % 256 AS byte FROM events)"


def streams(spark, d, group: str = "user_id"):
    """(user_id, grp, stream): the bytes of each user's events, in order, as a run-length stream."""
    import pandas as pd

    from loadlens.operators import codec

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        return pd.DataFrame([[rows["user_id"].iloc[0], rows["grp"].iloc[0], codec.rle_encode(bytes(rows["byte"].tolist()))]], columns=["user_id", "grp", "stream"])

    rows = X.table(spark, d, "events").select("user_id", F.expr(group).cast("long").alias("grp"), "ts", "event_id", F.expr("cast(floor(value) as bigint) % 256").alias("byte"))
    return rows.groupBy("user_id").applyInPandas(run, "user_id long, grp long, stream binary")


@query("a33_rle_merged_histogram", f"WITH {BYTES_SQL} SELECT byte, count(*) AS n FROM b GROUP BY 1")
def _(spark, d):
    import pandas as pd

    from loadlens.operators import codec

    def counts(batches):
        for frame in batches:
            found = codec.rle_histogram([bytes(x) for x in frame["stream"]])
            yield pd.DataFrame(sorted(found.items()), columns=["byte", "n"])

    return streams(spark, d).select("stream").mapInPandas(counts, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))


@query("c15_rle_streams", f"WITH {BYTES_SQL}, m AS (SELECT *, CASE WHEN lag(byte) OVER w = byte THEN 0 ELSE 1 END AS s FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS runs, CAST(sum(byte) AS BIGINT) AS total FROM m GROUP BY 1")
def _(spark, d):
    return stream_facts(streams(spark, d), "user_id")


@query("c16_rle_merge", f"WITH {BYTES_SQL}, m AS (SELECT *, user_id % 4 AS grp, CASE WHEN lag(byte) OVER w = byte THEN 0 ELSE 1 END AS s FROM b WINDOW w AS (PARTITION BY user_id % 4 ORDER BY user_id, ts, event_id)) SELECT grp, count(*) AS n, CAST(sum(s) AS BIGINT) AS runs, CAST(sum(byte) AS BIGINT) AS total FROM m GROUP BY 1")
def _(spark, d):
    import pandas as pd

    from loadlens.operators import codec

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [bytes(x) for x in rows.sort_values("user_id")["stream"]]
        return pd.DataFrame([[rows["grp"].iloc[0], codec.rle_merge(parts)]], columns=["grp", "stream"])

    return stream_facts(streams(spark, d, "user_id % 4").groupBy("grp").applyInPandas(merge, "grp long, stream binary"), "grp")


def stream_facts(found, key: str):
    """Bytes and their sum after decoding, and runs as they stand in the stream."""
    import pandas as pd

    from loadlens.operators import codec

    def facts(batches):
        for frame in batches:
            raw = [codec.rle_decode(bytes(x)) for x in frame["stream"]]
            runs = [len(codec.joined_runs([bytes(x)])) for x in frame["stream"]]
            yield pd.DataFrame({key: frame[key], "n": list(map(len, raw)), "runs": runs, "total": list(map(sum, raw))})

    return found.select(key, "stream").mapInPandas(facts, f"{key} long, n long, runs long, total long")


# ---- projections and filters ----

@query("p01_s20_metadata_fields", f"WITH {SHIP} SELECT metric, region, concat_ws(' | ', metric, region, CAST(count(DISTINCT rank) AS VARCHAR), CAST(max(step) AS VARCHAR)) AS line FROM ship GROUP BY 1, 2")
def _(spark, d):
    from loadlens.sources.store import fields

    meta = X.shipments(spark, d).groupBy("metric", "region").agg(F.countDistinct("rank").alias("rows"), F.max("step").alias("cols"))
    return fields(meta, "mtrc", {"m": "metric", "t": "region", "r": "rows", "c": "cols"}, keep=["metric", "region"])


@query("p02_p04_slice", f"WITH {E} SELECT region, rank, step, v FROM effort WHERE rank >= 3 AND rank < 7 AND step >= 10 AND step < 20")
def _(spark, d):
    return X.effort(spark, d).where("rank >= 3 and rank < 7 and step >= 10 and step < 20")


@query("p03_range_bounds", f"WITH {E} SELECT region, min(v) AS lo, max(v) AS hi FROM effort WHERE rank >= 4 AND rank < 12 GROUP BY 1")
def _(spark, d):
    return X.effort(spark, d).where("rank >= 4 and rank < 12").groupBy("region").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("p05_in_bounds", "SELECT CAST(range AS BIGINT) AS id, range // 70 < 16 AND range % 70 < 64 AS inside FROM range(1500)")
def _(spark, d):
    return spark.range(1500).select("id", F.expr("id div 70 < 16 and id % 70 < 64").alias("inside"))


@query("p09_empty_records", f"WITH {E} SELECT region, rank, count(*) AS n FROM fact GROUP BY 1, 2 HAVING count(*) > 0")
def _(spark, d):
    rows = X.event_facts(spark, d).groupBy("region", "rank").agg(F.collect_list("v").alias("vals"))
    return rows.where(F.size("vals") > 0).select("region", "rank", F.size("vals").cast("long").alias("n"))


@query("p10_metric_filter", f"WITH {SHIP} SELECT region, rank, step, v FROM ship WHERE metric = 'price'")
def _(spark, d):
    return X.shipments(spark, d).where("metric = 'price'").drop("metric")


@query("p11_containment", f"WITH {E} SELECT DISTINCT region FROM fact WHERE region NOT IN ('click', 'error')")
def _(spark, d):
    known = spark.createDataFrame([("click",), ("error",)], "region string")
    return X.event_facts(spark, d).select("region").distinct().join(known, "region", "left_anti")


@query("p12_collection_mode", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1")
def _(spark, d):
    from loadlens.streaming.comm import collected

    events = X.table(spark, d, "events").withColumn("kind", F.when(F.col("event_id") % 2 == 1, "effort").otherwise("comm"))
    return collected(events, "effort").groupBy("event_type").agg(F.count("*").alias("n"))


# ---- joins, orders, sets, windows ----

@query("j04_cell_join", f"WITH {E}, {SMOOTH_SQL} SELECT region, rank, step, {sql_r6('e.v - s.v')} AS d FROM effort e JOIN smooth s USING (region, rank, step)")
def _(spark, d):
    long = X.effort(spark, d)
    return long.join(smoothed(long).withColumnRenamed("v", "s"), ["region", "rank", "step"]).select("region", "rank", "step", r6(F.col("v") - F.col("s")).alias("d"))


MEANS_SQL = "mt AS (SELECT region, rank, sum(v) AS v FROM effort GROUP BY 1, 2)"


@query("j03_k01_region_distances", f"WITH {E} SELECT a.region AS a, b.region AS b, {sql_r6('sqrt(avg(pow(x.v - y.v, 2)))')} AS rmse FROM (SELECT DISTINCT region FROM effort) a JOIN (SELECT DISTINCT region FROM effort) b ON a.region < b.region JOIN effort x ON x.region = a.region JOIN effort y ON y.region = b.region AND y.rank = x.rank AND y.step = x.step GROUP BY 1, 2")
def _(spark, d):
    db = RegionDB(X.effort(spark, d).withColumn("metric", F.lit("value")), (X.RANKS, X.STEPS))
    return db.distances("value").withColumn("rmse", r6("rmse"))


@query("j06_key_file_names", f"WITH {SHIP}, k AS (SELECT region, metric, row_number() OVER (ORDER BY metric, region) - 1 AS id FROM (SELECT DISTINCT region, metric FROM ship)) SELECT k.region, metric, CASE WHEN id < 8 THEN 'effort-' || metric || '-0-' || CAST(id AS VARCHAR) ELSE 'unknown-' || metric || '-0' END AS file FROM k")
def _(spark, d):
    keys = X.shipments(spark, d).select("region", "metric").distinct()
    ids = numbered(keys, ["metric", "region"]).where("id < 8")
    named = keys.join(ids, ["region", "metric"], "left")
    return named.select("region", "metric", F.coalesce(F.concat(F.lit("effort-"), "metric", F.lit("-0-"), F.col("id").cast("string")), F.concat(F.lit("unknown-"), "metric", F.lit("-0"))).alias("file"))


@query("j09_metric_pivot", f"WITH {SHIP} SELECT region, {sql_r6('sum(v) FILTER (metric = $$price$$)', 2)} AS price, {sql_r6('sum(v) FILTER (metric = $$quantity$$)', 2)} AS quantity FROM ship GROUP BY 1")
def _(spark, d):
    return X.shipments(spark, d).groupBy("region").pivot("metric", ["price", "quantity"]).agg(r6(F.sum("v"), 2))


@query("o01_w05_key_ids", f"WITH {SHIP} SELECT metric, region, row_number() OVER (ORDER BY metric, region) - 1 AS id FROM (SELECT DISTINCT metric, region FROM ship)")
def _(spark, d):
    return numbered(X.shipments(spark, d).select("metric", "region").distinct(), ["metric", "region"])


@query("o02_regions_by_total", f"WITH t AS (SELECT event_id % 3 AS type, event_type AS region, {sql_r6('sum(value)', 4)} AS total FROM events GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY type ORDER BY total DESC, region) - 1 AS place FROM t")
def _(spark, d):
    t = X.table(spark, d, "events").groupBy(F.expr("event_id % 3").alias("type"), F.col("event_type").alias("region")).agg(r6(F.sum("value"), 4).alias("total"))
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("total"), "region")) - 1
    return t.withColumn("place", place.cast("long")).orderBy(F.col("type").cast("string"), F.desc("total"))


@query("o03_w06_by_sample_size", f"WITH {E}, {SIZE_SQL} SELECT region, size, row_number() OVER (ORDER BY size DESC, region) - 1 AS place FROM sample")
def _(spark, d):
    return numbered(sampled(spark, d).select("region", "size"), [F.desc("size"), "region"], "place")


@query("o04_first_key", f"WITH {SHIP} SELECT metric, region FROM ship ORDER BY metric, region LIMIT 1")
def _(spark, d):
    return X.shipments(spark, d).select("metric", "region").distinct().orderBy("metric", "region").limit(1)


@query("u01_key_union", f"WITH {E} SELECT DISTINCT region FROM fact")
def _(spark, d):
    facts = X.event_facts(spark, d)
    return facts.where("rank < 8").select("region").unionByName(facts.where("rank >= 8").select("region")).distinct()


@query("u02_new_keys", f"WITH {E} SELECT count(*) AS n FROM (SELECT DISTINCT region, rank FROM fact WHERE step >= 30 EXCEPT SELECT DISTINCT region, rank FROM fact WHERE step < 2)")
def _(spark, d):
    facts = X.event_facts(spark, d)
    late, early = facts.where("step >= 30").select("region", "rank").distinct(), facts.where("step < 2").select("region", "rank").distinct()
    return late.join(early, ["region", "rank"], "left_anti").agg(F.count("*").alias("n"))


@query("u03_selection_union", f"WITH {E} SELECT DISTINCT region FROM effort WHERE v > 100 OR rank = 3")
def _(spark, d):
    long = X.effort(spark, d)
    return long.where("v > 100").select("region").union(long.where("rank = 3").select("region")).distinct()


@query("w03_trailing_window", f"WITH {E} SELECT region, rank, list(v ORDER BY step) AS vals FROM effort WHERE step > (SELECT max(step) FROM fact) - 8 AND step <= (SELECT max(step) FROM fact) GROUP BY 1, 2")
def _(spark, d):
    facts = X.event_facts(spark, d)
    last = facts.agg(F.max("step").alias("last"))
    long = D.densify(facts, ["region"], X.RANKS, X.STEPS).crossJoin(F.broadcast(last)).where("step > last - 8 and step <= last")  # one row
    return D.to_rows(long, ["region", "rank"])


@query("w04_k10_process_distance", f"WITH {E}, m AS (SELECT region, rank, avg(v) AS m FROM effort WHERE step >= 8 AND step < 24 GROUP BY 1, 2) SELECT a.rank AS a, b.rank AS b, {sql_r6('sqrt(sum(pow(a.m - b.m, 2)))')} AS d FROM m a JOIN m b ON a.region = b.region AND a.rank < b.rank GROUP BY 1, 2")
def _(spark, d):
    m = X.effort(spark, d).where("step >= 8 and step < 24").groupBy("region", "rank").agg(F.avg("v").alias("m"))
    a, b = m.select("region", F.col("rank").alias("a"), F.col("m").alias("x")), m.select("region", F.col("rank").alias("b"), F.col("m").alias("y"))
    diff = F.col("x") - F.col("y")
    return a.join(b, "region").where("a < b").groupBy("a", "b").agg(r6(F.sqrt(F.sum(diff * diff))).alias("d"))


@query("w07_modulo_sets", f"WITH {SHIP} SELECT metric, region, (row_number() OVER (ORDER BY metric, region) - 1) % 5 AS set, (row_number() OVER (ORDER BY metric, region) - 1) // 5 * 5 AS base FROM (SELECT DISTINCT metric, region FROM ship)")
def _(spark, d):
    keys = X.shipments(spark, d).select("metric", "region").distinct()
    return numbered(keys, ["metric", "region"]).select("metric", "region", F.expr("id % 5").alias("set"), F.expr("id div 5 * 5").alias("base"))


@query("w08_place_among_siblings", "SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS place FROM nation")
def _(spark, d):
    return X.table(spark, d, "nation").select("n_regionkey", "n_name", (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")) - 1).cast("long").alias("place"))


@query("t21_transpose_to_processes", f"WITH {E} SELECT rank, step, list(v ORDER BY region) AS vals FROM effort GROUP BY 1, 2")
def _(spark, d):
    return D.to_rows(X.effort(spark, d), ["rank", "step"], "region")


@query("t25_pad_power_of_two", f"WITH {SHIP}, m AS (SELECT region, metric, max(step) + 1 AS n FROM ship GROUP BY 1, 2) SELECT region, metric, n, CASE WHEN n <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(bin(n - 1)) END AS padded FROM m")
def _(spark, d):
    return X.shipments(spark, d).groupBy("region", "metric").agg((F.max("step") + 1).alias("n")).withColumn("padded", D.pad_pow2(F.col("n")))


@query("t26_divisible", "SELECT CAST(range AS BIGINT) AS n, range % 8 = 0 AS ok FROM range(1025)")
def _(spark, d):
    return spark.range(1025).select(F.col("id").alias("n"), S.divisible_by_2("id", 3).alias("ok"))


@query("t23_range_fill", f"WITH {E} SELECT region, rank, step, CASE WHEN rank < 4 AND step < 8 THEN 1.5 ELSE v END AS v FROM effort")
def _(spark, d):
    return X.effort(spark, d).withColumn("v", F.when(F.expr("rank < 4 and step < 8"), 1.5).otherwise(F.col("v")))


@query(
    "t22_bilinear",
    f"""WITH {E}, m AS (SELECT rank, step, sum(v) AS v FROM effort GROUP BY 1, 2), p AS (SELECT range AS id, least(range * 0.37, 15.0) AS r, least(range * 1.13, 63.0) AS c FROM range(60)),
q AS (SELECT id, r, c, floor(r) AS r0, ceil(r) AS r1, floor(c) AS c0, ceil(c) AS c1 FROM p)
SELECT CAST(id AS BIGINT) AS id, {sql_r6('(a.v * (1 - (c - c0)) + b.v * (c - c0)) * (1 - (r - r0)) + (x.v * (1 - (c - c0)) + y.v * (c - c0)) * (r - r0)', 4)} AS v FROM q JOIN m a ON a.rank = r0 AND a.step = c0 JOIN m b ON b.rank = r0 AND b.step = c1 JOIN m x ON x.rank = r1 AND x.step = c0 JOIN m y ON y.rank = r1 AND y.step = c1""",
)
def _(spark, d):
    m = D.to_rows(X.effort(spark, d).groupBy("rank", "step").agg(F.sum("v").alias("v")), ["rank"])
    p = spark.range(60).select("id", F.least(F.col("id") * 0.37, F.lit(15.0)).alias("r"), F.least(F.col("id") * 1.13, F.lit(63.0)).alias("c"))
    row = lambda i: m.select(F.col("rank").alias(f"at{i}"), F.col("vals").alias(f"r{i}"))
    both = p.withColumns({"at0": F.floor("r"), "at1": F.ceil("r")}).join(row(0), "at0").join(row(1), "at1")
    return stats.bilinear(both, F.col("r"), F.col("c")).select("id", r6("v", 4).alias("v"))


@query("f32_scale_ratio", f"WITH {E} SELECT region, {sql_r6('0.5 * least(16, 64) / CASE WHEN max(v) > min(v) THEN max(v) - min(v) ELSE 1 END')} AS scale FROM effort GROUP BY 1")
def _(spark, d):
    span = F.max("v") - F.min("v")
    return X.effort(spark, d).groupBy("region").agg(r6(F.lit(0.5) * 16 / F.when(span > 0, span).otherwise(1.0)).alias("scale"))


@query("s24_synthetic_log", f"SELECT r.range AS rank, i.range AS step, k.range AS k, {sql_r6('CAST((0.06 + r.range) * (5 + i.range + 0.4 * i.range * i.range - 0.02 * i.range * i.range * k.range) AS DOUBLE)')} AS v FROM range(8) r, range(32) i, range(4) k")
def _(spark, d):
    from loadlens.sources.synthetic import synthetic_log

    return synthetic_log(spark, ranks=8, steps=32, paths=4).withColumn("v", r6("v"))


WINDOW = 16  # steps between two updates
UPDATE_SQL = f"""pr AS (SELECT step // {WINDOW} + 1 AS u, region, rank, sum(v) AS v FROM effort GROUP BY 1, 2, 3), ps AS (SELECT u, region, sum(v) AS s, sum(v * v) AS s2, count(*) AS n FROM pr GROUP BY 1, 2),
pz AS (SELECT u, n, CAST(round(n / (1 + n * pow(0.08 * (s / n) / ({Z95} * greatest(sqrt(greatest(s2 / n - (s / n) * (s / n), 0)), 1e-9)), 2))) AS BIGINT) AS size FROM ps),
up AS (SELECT u, max(n) AS size, greatest(max(size), 1) AS sample, greatest(max(size), 1) / max(n) AS proportion FROM pz GROUP BY 1)"""


def updated(spark, d):
    return sampling.updates(X.effort(spark, d), ["region"], WINDOW, 0.95, 0.08)


@query("x07_adaptive_update", f"WITH {E}, {UPDATE_SQL} SELECT u AS update, r.range AS rank, sample, {sql_r6('proportion')} AS proportion, (r.range * 7919 + u * 104729) % 1000 / 1000.0 < proportion AS enabled FROM up, range(16) r")
def _(spark, d):
    every = updated(spark, d).withColumn("rank", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    # The draw of an update is against the proportion that it has just set.
    return every.select("update", "rank", "sample", r6("proportion").alias("proportion"), (((F.col("rank") * 7919 + F.col("update") * 104729) % 1000) / 1000.0 < F.col("proportion")).alias("enabled"))


@query("s18_summary_lines", f"WITH {E}, {UPDATE_SQL} SELECT u AS update, printf('STEP %d Size %d SampleSize %d Proportion %.4f', u * {WINDOW}, size, sample, proportion) AS line FROM up")
def _(spark, d):
    return sampling.summary_lines(updated(spark, d), WINDOW)
