"""A synthetic effort log: polynomial effort for some call paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_log(spark: SparkSession, ranks: int, steps: int = 1024, paths: int = 16) -> DataFrame:
    """(rank, step, k, v) made in place from one range, without joins."""
    at = spark.range(ranks * steps * paths)
    cells = at.select(F.expr(f"id div {steps * paths}").alias("rank"), F.expr(f"id div {paths} % {steps}").alias("step"), F.expr(f"id % {paths}").alias("k"))
    i = F.col("step")
    return cells.withColumn("v", (F.lit(0.06) + F.col("rank")) * (5 + i + 0.4 * i * i - 0.02 * i * i * F.col("k")))
