"""Process sampling: draws, proportions and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions.scalars import sample_size


def enabled(rank, update, proportion: float) -> Column:
    """Whether a rank is in the sample of an update: a draw that reruns repeat."""
    rank, update = (F.col(c) if isinstance(c, str) else c for c in (rank, update))
    return ((rank * 7919 + update * 104729) % 1000) / 1000.0 < proportion


def proportions(long: DataFrame, keys: list[str], strata: list[str], confidence: float = 0.9, error: float = 0.08) -> DataFrame:
    """(strata, size, sample, proportion): a stratum samples as many processes as its most demanding key needs.

    long(keys, strata, rank, v) with one value for each process and key.
    """
    per = long.groupBy(*strata, *keys).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.count("*").alias("n"))
    need = per.withColumn("need", sample_size("s", "s2", "n", confidence, error))
    out = need.groupBy(*strata).agg(F.max("n").alias("size"), F.greatest(F.max("need"), F.lit(1).cast("long")).alias("sample"))
    return out.withColumn("proportion", F.col("sample") / F.col("size"))


def updates(long: DataFrame, keys: list[str], every: int, confidence: float = 0.9, error: float = 0.08) -> DataFrame:
    """(update, size, sample, proportion): the proportions anew after every so many steps, from the values of the window that ends there.

    long(keys, rank, step, v).
    """
    window = long.withColumn("update", F.expr(f"step div {every} + 1"))
    per = window.groupBy(*keys, "rank", "update").agg(F.sum("v").alias("v"))
    return proportions(per, keys, ["update"], confidence, error)


def summary_lines(updated: DataFrame, every: int) -> DataFrame:
    """(update, line): what an update's summary says."""
    step = F.col("update") * every
    return updated.select("update", F.format_string("STEP %d Size %d SampleSize %d Proportion %.4f", step, "size", "sample", "proportion").alias("line"))


def write_summary(updated: DataFrame, every: int, path: str) -> None:
    """Append the updates' lines, a file a task; a stream calls it from foreachBatch."""
    summary_lines(updated, every).select("line").write.mode("append").text(path)


def stratified_is_better(strata: DataFrame, whole: DataFrame) -> DataFrame:
    """Whether the strata's samples together are smaller than the sample without strata."""
    return strata.agg(F.sum("sample").alias("stratified")).crossJoin(whole.select(F.col("sample").alias("global"))).withColumn("good", F.col("stratified") < F.col("global"))
