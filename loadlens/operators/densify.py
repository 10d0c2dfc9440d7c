"""Keyed accumulation, dense matrices and their two layouts.

Long: keys, rank, step, v. Rows: keys, rank, vals ARRAY<DOUBLE>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accumulate(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """One row a key: map-side partial sums, one shuffle on the keys."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def pad_pow2(n: Column) -> Column:
    """The least power of two that is not below n."""
    from loadlens.functions.scalars import ge_power_of_2

    return ge_power_of_2(n)


def densify(facts: DataFrame, keys: list[str], ranks: int, steps: int) -> DataFrame:
    """Every rank and step of every key, zero where nothing was committed.

    Keys are expanded in place, so the only shuffles are those of the distinct
    keys and of the join with the facts, both on the full key.
    """
    grid = facts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranks - 1).cast("long"))).alias("rank"))
    grid = grid.select(*keys, "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("step"))
    return grid.join(facts, [*keys, "rank", "step"], "left").select(*keys, "rank", "step", F.coalesce("v", F.lit(0.0)).alias("v"))


def to_rows(long: DataFrame, keys: list[str], at: str = "step") -> DataFrame:
    """Long to arrays ordered by position: one shuffle on the keys."""
    made = F.sort_array(F.collect_list(F.struct(F.col(at).alias("i"), F.col("v").alias("v"))))
    return long.groupBy(*keys).agg(F.transform(made, lambda x: x["v"]).alias("vals"))


def sparse_to_rows(facts: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Facts straight to dense arrays: no grid, no join, the least data shuffled."""
    by_step = F.map_from_entries(F.collect_list(F.struct("step", "v")))
    grouped = facts.groupBy(*keys).agg(by_step.alias("m"))
    return grouped.select(*keys, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long")), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0.0))).alias("vals"))


def to_long(rows: DataFrame, keys: list[str], at: str = "step") -> DataFrame:
    return rows.select(*keys, F.posexplode("vals").alias(at, "v")).withColumn(at, F.col(at).cast("long"))


def transpose(rows: DataFrame, keys: list[str], at: str = "rank", to: str = "step") -> DataFrame:
    """Rows (keys, at, vals) to rows (keys, to, vals): one shuffle."""
    return to_rows(to_long(rows, [*keys, at], to), [*keys, to], at)
