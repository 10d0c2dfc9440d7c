"""Text matrices: space-separated numbers, a row a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_matrix(rows: DataFrame, path: str) -> None:
    """rows(rank, vals) as lines in order of rank, numbers 12 wide; the row number leads each line's file order."""
    text = F.array_join(F.transform("vals", lambda v: F.lpad(v.cast("string"), 12, " ")), " ")
    rows.orderBy("rank").select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)  # one matrix is one file


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(rank, vals) of one text matrix. Rows are as long as the first line says: longer ones are cut, shorter ones refused.

    Lines are numbered by their place in the file, so a matrix is one file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("rank", "line")).where(F.trim("line") != "")
    vals = F.transform(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    rows = lines.select(F.col("rank").cast("long").alias("rank"), vals.alias("vals"))
    width = rows.agg(F.min_by(F.size("vals"), "rank").alias("w"))
    both = rows.crossJoin(F.broadcast(width))  # one row
    short = F.raise_error(F.concat(F.lit("too few numbers in row "), F.col("rank").cast("string")))
    return both.select("rank", F.when(F.size("vals") < F.col("w"), short.cast("array<double>")).otherwise(F.slice("vals", 1, F.col("w"))).alias("vals"))


def concat_parts(parts: DataFrame, name: str = "name") -> DataFrame:
    """Rows of exact-<name>-<rank> parts in numeric order of rank, numbered within each name."""
    pattern = r"^exact-(.*)-(\d+)$"
    found = parts.select(F.regexp_extract(name, pattern, 1).alias("effort"), F.regexp_extract(name, pattern, 2).cast("long").alias("rank"), "vals")
    return found.withColumn("row", F.row_number().over(Window.partitionBy("effort").orderBy("rank")) - 1)
