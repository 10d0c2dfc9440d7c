"""The engine's logical inputs, read from the star-schema tables, with the same in SQL.

effort: (region, rank, step, v), dense; signals: (id, pos, v); paths: one call
path a customer, frames (module, off) innermost first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.operators.densify import accumulate, densify

RANKS, STEPS = 16, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def half_day(ts: str = "ts"):
    return F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts}) div 12")


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse effort: one row for each region, rank and step with events."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("region"), F.expr("user_id % 16").alias("rank"), half_day().alias("step"), "value")
    return accumulate(events, ["region", "rank", "step"], {"v": F.round(F.sum("value"), 4)})


def effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense effort of 5 regions, 16 ranks and 64 half-day steps."""
    return densify(event_facts(spark, sf_dir), ["region"], RANKS, STEPS)


EFFORT_SQL = f"""fact AS (SELECT event_type AS region, user_id % 16 AS rank, CAST(floor(date_diff('hour', TIMESTAMP '2024-01-01', ts) / 12.0) AS BIGINT) AS step,
   round(sum(value), 4) AS v FROM events GROUP BY 1, 2, 3),
effort AS (SELECT g.region, g.rank, g.step, coalesce(fact.v, 0) AS v FROM (SELECT region, r.range AS rank, s.range AS step
   FROM (SELECT DISTINCT event_type AS region FROM events), range({RANKS}) r, range({STEPS}) s) g LEFT JOIN fact USING (region, rank, step))"""


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse two-metric effort of lineitem: region, rank, step, metric, v."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("region"),
        F.expr("l_suppkey % 16").alias("rank"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long").alias("step"),
        F.expr("stack(2, 'quantity', l_quantity, 'price', l_extendedprice) AS (metric, x)"),
    )
    return accumulate(rows, ["region", "rank", "step", "metric"], {"v": F.round(F.sum("x"), 2)})


SHIPMENTS_SQL = """ship AS (SELECT l_returnflag || l_linestatus AS region, l_suppkey % 16 AS rank, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS step,
   m.metric, round(sum(CASE m.metric WHEN 'quantity' THEN l_quantity ELSE l_extendedprice END), 2) AS v
   FROM lineitem, (VALUES ('quantity'), ('price')) m(metric) GROUP BY 1, 2, 3, 4)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vals, label): 64 doubles each."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vals"), "label")


SIGNALS_SQL = """sig AS (SELECT vec_id AS id, label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, path): region, nation and customer frames, innermost first, with an alias module on every fifth."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 and 5 rows at any scale
    nation = F.when(F.col("c_custkey") % 5 == 0, F.lit("[unknown module]")).otherwise(F.col("n_name"))
    frame = lambda m, o: F.struct(m.alias("module"), o.cast("long").alias("off"))
    return joined.select(
        F.col("c_custkey").alias("path_id"),
        F.array(frame(F.col("c_mktsegment"), F.col("c_custkey")), frame(nation, F.col("n_nationkey")), frame(F.col("r_name"), F.col("r_regionkey"))).alias("path"),
    )


PATHS_SQL = """frame AS (SELECT c_custkey AS path_id, 0 AS depth, c_mktsegment AS module, CAST(c_custkey AS BIGINT) AS off FROM customer
 UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 5 = 0 THEN '[unknown module]' ELSE n_name END, CAST(n_nationkey AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT c_custkey, 2, r_name, CAST(r_regionkey AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, off, file, line, symbol) for all nations but every seventh."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).where("n_nationkey % 7 <> 0")
    return joined.select(F.col("n_name").alias("module"), F.col("n_nationkey").cast("long").alias("off"), F.concat(F.lower("r_name"), F.lit(".c")).alias("file"), F.col("n_nationkey").cast("int").alias("line"), F.concat(F.lit("fn_"), F.lower("n_name")).alias("symbol"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alias, target): what the unknown module stands for."""
    return table(spark, sf_dir, "nation").where("n_nationkey = 0").select(F.lit("[unknown module]").alias("alias"), F.col("n_name").alias("target"))


SYMBOLS_SQL = """symtab AS (SELECT n_name AS module, CAST(n_nationkey AS BIGINT) AS off, lower(r_name) || '.c' AS file, CAST(n_nationkey AS INTEGER) AS line, 'fn_' || lower(n_name) AS symbol
   FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 0),
alias AS (SELECT '[unknown module]' AS alias, n_name AS target FROM nation WHERE n_nationkey = 0)"""
