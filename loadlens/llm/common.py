"""What the training-data operators share: words, checkpoints, table access.

A word is a maximal run of code points outside the six ASCII white-space
characters (space and U+0009 to U+000D); no other space splits words.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text, on the JVM; null and blank texts have none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_RE))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash01(*cols: Column) -> Column:
    """A reproducible draw from the open interval (0, 1): 52 bits of an MD5 sum."""
    digits = F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where that is unset, a temporary one on a single machine (tests), and an
    error on a cluster, whose executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="loadlens-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ranged(df: DataFrame, by: list) -> DataFrame:
    """df dealt by range, with the number of each row's range: fixed by a checkpoint, so that later passes agree."""
    return cut(df.repartitionByRange(*by)).withColumn("_range", F.spark_partition_id())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


BROADCAST_BYTES = 32 << 20


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row: texts by their length, all else that varies by its JSON text, eight for the rest."""
    fixed, texts = F.lit(8 * len(df.columns)), [F.octet_length(c) for c, t in df.dtypes if t in ("string", "binary")]
    nested = [F.octet_length(F.to_json(F.struct(c))) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    return sum((F.coalesce(n, F.lit(0)) for n in texts + nested), fixed)


def broadcast_if_small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A hint to broadcast a table cut() before, if its rows and their bytes are counted to be few.

    Beyond that many rows, or BROADCAST_BYTES, the join is left to the planner, which shuffles both
    sides and splits skewed partitions.
    """
    found, size = df.agg(F.count("*"), F.sum(_bytes(df).cast("long"))).first()
    return F.broadcast(df) if found <= rows and (size or 0) <= BROADCAST_BYTES else df
