"""Symbol tables and phase times as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_symbols(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (value) of file|line|symbol|module|0xoffset and alias => module to a symbol and an alias table.

    '?' fields are null.
    """
    known = lambda c: F.when(F.trim(c) != "?", F.trim(c))
    parts = F.split("value", r"\|")
    rows = lines.where(F.size(parts) == 5).select(parts.alias("p"))
    off = F.conv(F.regexp_replace(F.trim(F.get("p", 4)), "^0x", ""), 16, 10).cast("long")
    symbols = rows.select(F.trim(F.get("p", 3)).alias("module"), off.alias("off"), known(F.get("p", 0)).alias("file"), known(F.get("p", 1)).cast("int").alias("line"), known(F.get("p", 2)).alias("symbol"))
    sides = F.split("value", "=>")
    aliases = lines.where(F.size(sides) == 2).select(F.trim(F.get(sides, 0)).alias("alias"), F.trim(F.get(sides, 1)).alias("target"))
    return symbols, aliases


def symbol_line(file, line, symbol, module, off) -> Column:
    mark = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat_ws("|", mark(file), mark(line), mark(symbol), module, F.concat(F.lit("0x"), F.lower(F.hex(off))))


def read_symbols(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_symbols(spark.read.text(path))


def build_symbols(reports: DataFrame) -> DataFrame:
    """Distinct symbol lines from report lines 'file:line symbol module(0xoff)'."""
    pattern = r"^(.+?):(\d+|\?\?) (\S+) (.*)\(0x([0-9a-fA-F]+)\)$"
    g = lambda i: F.regexp_extract("value", pattern, i)
    mark = lambda c: F.when(c == "??", F.lit("?")).otherwise(c)
    return reports.where(F.col("value").rlike(pattern)).select(F.concat_ws("|", mark(g(1)), mark(g(2)), mark(g(3)), g(4), F.concat(F.lit("0x"), F.lower(g(5)))).alias("line")).distinct()


def times_lines(times: DataFrame, total: bool = True) -> DataFrame:
    """times(name, first, ns) to lines 'name:  seconds' in order of first, with a Total."""
    seconds = lambda ns: F.format_string("%.9f", ns / 1e9)
    out = times.select("first", F.concat("name", F.lit(":  "), seconds(F.col("ns"))).alias("value"))
    if total:
        whole = times.agg(F.sum("ns").alias("ns")).select(F.lit(2**62).alias("first"), F.concat(F.lit("Total:  "), seconds(F.col("ns"))).alias("value"))
        out = out.unionByName(whole)
    return out


def parse_times(lines: DataFrame) -> DataFrame:
    """Lines 'name:  seconds' to (name, ns)."""
    parts = F.split(F.col("value"), r":\s+")
    return lines.select(F.get(parts, 0).alias("name"), F.round(F.get(parts, 1).cast("double") * 1e9).cast("long").alias("ns"))
