"""Summaries of matrices, error metrics, sampling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_moments(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, n, mean, variance, skew, kurtosis): divisors n - 1; null for constant rows."""
    n = F.count("v")
    var = F.var_samp("v")
    ok = var > 1e-12
    return long.groupBy(*keys, "rank").agg(
        n.alias("n"),
        F.avg("v").alias("mean"),
        var.alias("variance"),
        F.when(ok, F.skewness("v") * F.sqrt((n - 1) / n)).alias("skew"),
        F.when(ok, (F.kurtosis("v") + 3) * (n - 1) / n).alias("kurtosis"),
    )


def summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and extremes of a key, and mean, least and greatest of its rows' moments.

    Two levels: rows first, whose sums, counts and extremes also give the
    whole's. One shuffle on (keys, rank), a small one on the keys.
    """
    n, var = F.count("v"), F.var_samp("v")
    ok = var > 1e-12
    rows = long.groupBy(*keys, "rank").agg(
        F.sum("v").alias("s"),
        n.alias("n"),
        F.max("v").alias("hi"),
        F.min("v").alias("lo"),
        F.max(F.abs("v")).alias("top"),
        var.alias("variance"),
        F.when(ok, F.skewness("v") * F.sqrt((n - 1) / n)).alias("skew"),
        F.when(ok, (F.kurtosis("v") + 3) * (n - 1) / n).alias("kurtosis"),
    )
    three = [f(m).alias(f"{name}_{m}") for m in ("variance", "skew", "kurtosis") for name, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    out = rows.groupBy(*keys).agg(F.sum("s").alias("total"), F.sum("n").alias("count"), F.max("hi").alias("max"), F.min("lo").alias("min"), F.max("top").alias("abs_max"), *three)
    roots = {f"{name}_deviation": F.sqrt(f"{name}_variance") for name in ("mean", "max", "min")}
    return out.withColumn("mean", F.col("total") / F.col("count")).withColumns(roots)


def errors(a: DataFrame, b: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    """Error metrics of reproductions b of originals a, both (keys, cells, v)."""
    both = a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), [*keys, *cells])
    d = F.col("x") - F.col("y")
    sums = both.groupBy(*keys).agg(F.sum(d * d).alias("squares"), F.count("*").alias("n"), F.max("x").alias("hi"), F.min("x").alias("lo"), F.max(F.greatest("x", "y")).alias("hi2"), F.min(F.least("x", "y")).alias("lo2"), F.max(F.abs(d)).alias("worst"))
    rmse = F.sqrt(F.col("squares") / F.col("n"))
    span, wide = F.col("hi") - F.col("lo"), F.col("hi2") - F.col("lo2")
    return sums.select(*keys, "squares", "worst", rmse.alias("rmse"), F.try_divide(rmse, span).alias("nrmse"), F.when((rmse > 0) & (span > 0), 20 * F.log10(F.try_divide(span, rmse))).alias("psnr"), F.try_divide(rmse, wide).alias("similarity"))


def standardize(long: DataFrame, keys: list[str]) -> DataFrame:
    """z-scores by the key's population deviation; 0 where that is 0.

    Means come from an aggregate that is joined back, so a key is not one task.
    """
    stats = long.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("v") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return long.join(stats, keys).withColumn("z", z).drop("_m", "_s")


def five_numbers(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """min (0 counts as 1), element n div 4, mean, element n - n div 4, max, in order of size.

    Places are found by row numbers over the key, so no value list is collected.
    """
    w = Window.partitionBy(*keys)
    n = F.count(v).over(w)
    at = df.withColumns({"_i": F.row_number().over(w.orderBy(v)) - 1, "_n": n})
    low = F.when(F.col("_i") == F.floor(F.col("_n") / 4), F.col(v))
    high = F.when(F.col("_i") == F.least(F.col("_n") - F.floor(F.col("_n") / 4), F.col("_n") - 1), F.col(v))
    least = F.min(v)
    return at.groupBy(*keys).agg(F.when(least == 0, 1).otherwise(least).cast("double").alias("low"), F.max(low).alias("q1"), F.avg(v).alias("mean"), F.max(high).alias("q3"), F.max(v).alias("high"))


def bilinear(rows: DataFrame, at_row: Column, at_col: Column) -> DataFrame:
    """points joined to matrix rows beforehand: value at a fractional place, clamped to the matrix.

    rows needs r0 and r1, the arrays of the two neighbouring rows.
    """
    last = F.size("r0") - 1
    c = F.greatest(F.lit(0.0), F.least(at_col, last.cast("double")))
    c0, c1 = F.floor(c).cast("int"), F.ceil(c).cast("int")
    fr, fc = at_row - F.floor(at_row), c - F.floor(c)
    get = lambda a, i: F.get(F.col(a), i)
    top = get("r0", c0) * (1 - fc) + get("r0", c1) * fc
    low = get("r1", c0) * (1 - fc) + get("r1", c1) * fc
    return rows.withColumn("v", top * (1 - fr) + low * fr)
