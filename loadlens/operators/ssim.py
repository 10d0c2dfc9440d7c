"""Structural similarity over wavelet subbands: sliding box sums as window frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 0.01


def box_sums(cells: DataFrame, keys: list[str], columns: list[str], box: int) -> DataFrame:
    """Sums over box x box neighbourhoods that end at each cell; cells without a whole one are gone.

    The sum is separable: along steps, then along ranks; two shuffles.
    """
    along = Window.partitionBy(*keys, "rank").orderBy("step").rowsBetween(-(box - 1), 0)
    down = Window.partitionBy(*keys, "step").orderBy("rank").rowsBetween(-(box - 1), 0)
    first = Window.partitionBy(*keys, "rank").orderBy("step")
    second = Window.partitionBy(*keys, "step").orderBy("rank")
    out = cells.withColumns({c: F.sum(c).over(along) for c in columns} | {"_i": F.row_number().over(first)})
    out = out.withColumns({c: F.sum(c).over(down) for c in columns} | {"_j": F.row_number().over(second)})
    return out.where((F.col("_i") >= box) & (F.col("_j") >= box)).drop("_i", "_j")


def local_similarity(sxy, sxx, syy):
    return (2 * F.abs(sxy) + K) / (sxx + syy + K)


def subband(rows: int, cols: int, level: int):
    """Name and level of a coefficient's band: LL, or HL, LH, HH of a level (1 is the finest)."""
    out = F.lit(None).cast("string")
    for k in range(1, level + 1):
        r, c = rows >> k, cols >> k
        inside = (F.col("rank") < 2 * r) & (F.col("step") < 2 * c)
        low_r, low_c = F.col("rank") < r, F.col("step") < c
        out = F.when(inside, F.when(low_r & low_c, f"LL{k}").when(low_r, f"HL{k}").when(low_c, f"LH{k}").otherwise(f"HH{k}")).otherwise(out)
    return out


def band_similarity(cells: DataFrame, keys: list[str], rows: int, cols: int, level: int, box: int = 7) -> DataFrame:
    """cells(keys, rank, step, x, y) of coefficients: mean local similarity of each band that holds a box."""
    banded = cells.withColumn("band", subband(rows, cols, level)).withColumns({"xy": F.col("x") * F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y")})
    sums = box_sums(banded, [*keys, "band"], ["xy", "xx", "yy"], box)
    return sums.groupBy(*keys, "band").agg(F.avg(local_similarity(F.col("xy"), F.col("xx"), F.col("yy"))).alias("similarity"))


def wssim(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the low band and the levels' mean details; null without any band."""
    level = F.when(F.col("band").startswith("LL"), F.lit("LL")).otherwise(F.substring("band", 3, 2))
    per = bands.withColumn("l", level).groupBy(*keys, "l").agg(F.avg("similarity").alias("s"))
    return per.groupBy(*keys).agg(F.avg("s").alias("wssim"))
