"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its share of the mix, by water filling: sources weigh
in, none goes beyond CAP times its size, and what they cannot take is shared
again by weight. With r = target / size, every document of the source is first
allocated floor(r) whole copies; the remaining share p = r - floor(r) is sampled.
A document draws u in (0, 1) from its id, and documents rank by the odds
u / (1 - u) over the odds of inclusion p / (1 - p), as in Pareto order
sampling (Rosen 1997). The first ones are taken until their words reach the rest of the
target, so the sample's size in words is fixed, not only its expectation.

The cut in a source's order is found without sorting the source in one task:
within a source the order is that of the draws, so documents fall into SLICES even slices of them, words are added up by slice, and only
the one slice that the cut falls into is ordered document by document, rows that repeat a document being added up before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.llm.common import broadcast_if_small, cut, hash01, ranged, table, words

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
SLICES = 4096
SEED = "mix"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), a row a source.

    The water level is the same for all sources below their cap: capped ones
    come first by cap over weight, and running sums find how many there are. Both orders
    are dealt by range, so that no task needs all sources.
    """
    order = [F.col("source").asc_nulls_last()]
    given = ranged(sizes, order)
    start, of = _starts(given, n=F.count("*")), Window.partitionBy("_range")
    place = F.col("before_n") + F.row_number().over(of.orderBy(*order)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    given = given.join(F.broadcast(start), "_range").withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size")).drop("_range", "before_n", "all_n")
    fill = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    given = ranged(given, fill)
    start = _starts(given, caps=F.sum("cap"), weights=F.sum("weight"))
    given = given.join(F.broadcast(start), "_range")
    earlier = of.orderBy(*fill).rowsBetween(Window.unboundedPreceding, -1)
    caps, weights = (F.col(f"before_{c}") + F.coalesce(F.sum(x).over(earlier), F.lit(0)) for c, x in (("caps", "cap"), ("weights", "weight")))
    total = F.lit(SHARE_PERCENT) * (F.col("all_caps") / CAP) / F.lit(100.0)
    # The level if all sources before this one are capped; the first that it does not fill is the last to ask.
    given = given.withColumn("level", (total - caps) / (F.col("all_weights") - weights))
    asks = given.where(F.col("level") * F.col("weight") <= F.col("cap"))
    level = asks.agg(F.min(F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))["level"].alias("water"))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("water", F.lit(float("inf"))))
    return given.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"))  # a row


def _starts(rows: DataFrame, **sums) -> DataFrame:
    """(_range, before_x, all_x) for each sum x: a row a range."""
    by_range = rows.groupBy("_range").agg(*[c.alias(x) for x, c in sums.items()])
    all_ = Window.partitionBy(F.lit(0))
    upto = all_.orderBy("_range")
    return by_range.select("_range", *[(F.sum(x).over(upto) - F.col(x)).alias(f"before_{x}") for x in sums], *[F.sum(x).over(all_).alias(f"all_{x}") for x in sums])


def _drawn(docs: DataFrame) -> list:
    """What the mix needs of each row: id, source, size and the draw u."""
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    return [docs["doc_id"], docs["source"], F.size(words(docs["text"])).cast("long").alias("size"), hash01(F.lit(SEED), key).alias("u")]


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows beside their source's plan, with x, the place in the Pareto order."""
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    x = F.when(F.col("p") > 0, q / (1 + q)).otherwise(F.lit(1.0))
    joined = rows.join(broadcast_if_small(plan.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    joined = joined.withColumn("x", x).withColumn("slice", F.floor(F.col("u") * SLICES).cast("int"))
    return joined.withColumn("place", F.struct("x", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "size"))


def mix_plan(sized: DataFrame) -> DataFrame:
    """A row a source: target, whole copies, p, and the last place that is taken."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets(sizes).withColumn("whole", F.floor(ratio).cast("long")).withColumn("p", ratio - F.col("whole"))
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    ranked = _ranked(sized, plan).where("p > 0")
    sums = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words"))
    crossed = sums.where("before < rest and before + words >= rest").select(F.col("source").alias("of"), F.col("slice").alias("at"), "before")
    plan = cut(plan.join(crossed, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"))
    order = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = _ranked(sized, plan).where("p > 0 and slice = at").groupBy("source", "place").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inside = inside.withColumn("running", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = inside.where("running + size / 2.0 <= rest").groupBy("source").agg(F.max("place").alias("last")).withColumnRenamed("source", "of")
    return cut(plan.join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "before"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, copies and taken.

    A null text has size 0 and takes 0 words, though it may be given copies;
    null sources are one source, the last. Rows that repeat an id draw alike and
    are taken in the order of their size; equal ones are taken or left together.
    A source without words gets the target 0. Other columns come back as they
    are; those that clash with the new ones give way to them.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    plan = mix_plan(cut(docs.select(*_drawn(docs))))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in new]).alias("row"), *_drawn(docs))
    sampled = (F.col("p") > 0) & ((F.col("slice") < F.col("at")) | ((F.col("slice") == F.col("at")) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False))))
    copies = F.col("whole") + F.coalesce(sampled, F.lit(False)).cast("long")
    return _ranked(rows, plan).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select("row.*", *new)


def draw(docs: DataFrame) -> DataFrame:
    """The mix itself: docs with their own columns, each as often as it is taken."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_mix_row"), docs["doc_id"], docs["text"], docs["source"])
    taken = mixed(whole).where("copies > 0")
    return taken.select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_mix_copy")).select("_mix_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
   (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / CAST({2**52} AS DOUBLE) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight, {CAP} * source_size AS cap FROM s),
f AS (SELECT *, ({SHARE_PERCENT} * sum(source_size) OVER () / CAST(100 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT min(level) AS level FROM (SELECT level FROM f WHERE level * weight <= cap ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST LIMIT 1)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * coalesce(g.level, CAST('inf' AS DOUBLE))) AS target FROM f, g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole FROM t),
x AS (SELECT d.*, source_size, target, whole, r - whole AS p, target - whole * source_size AS rest, (u / (1 - u)) / ((r - whole) / (1 - (r - whole))) AS q
   FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN p > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o"""
