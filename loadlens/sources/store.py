"""Effort stores: Parquet by metric, file names, metadata reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Report letters and the metadata columns that they stand for.
LETTERS = {"m": "metric", "t": "type", "a": "start_path", "z": "end_path", "s": "scale", "r": "rows", "c": "cols", "l": "level", "S": "ezw_size", "M": "mean", "T": "threshold", "e": "encoding", "b": "blocks", "p": "passes", "E": "enc_size", "R": "rle_size", "Z": "ratio"}


def write_effort(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """rows(metric, ..., rank, vals) as Parquet by metric: a reader of one metric opens its folder alone."""
    rows.write.mode(mode).partitionBy("metric").parquet(path)


def read_effort(spark: SparkSession, path: str, metric: str | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found if metric is None else found.where(F.col("metric") == metric)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Keys and row counts; column pruning leaves the values unread."""
    return spark.read.parquet(path).drop("vals")


def file_name(metric, kind, number) -> Column:
    return F.concat_ws("-", F.lit("effort"), metric, kind.cast("string"), number.cast("string"))


def parse_file_name(name: Column) -> Column:
    """Struct of metric, type and number; null unless effort-metric-integer-integer."""
    parts = F.split(name, "-")
    ok = (F.size(parts) == 4) & F.startswith(name, F.lit("effort")) & F.get(parts, 2).rlike(r"^\d+$") & F.get(parts, 3).rlike(r"^\d+$")
    return F.when(ok, F.struct(F.get(parts, 1).alias("metric"), F.get(parts, 2).try_cast("int").alias("type"), F.get(parts, 3).try_cast("int").alias("number")))


def fields(meta: DataFrame, letters: str, names: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One line a row of the chosen fields, joined by ' | '."""
    names = names or LETTERS
    line = F.concat_ws(" | ", *[F.col(names[x]).cast("string") for x in letters])
    return meta.select(*(keep or []), line.alias("line"))
