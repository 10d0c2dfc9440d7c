"""Where intermediate results live, and rows numbered in order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one on a single machine that names none, an error on a cluster."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="loadlens-")


def scratch(spark: SparkSession) -> str:
    """A new path that all executors see."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, by: list, name: str = "id") -> DataFrame:
    """df with gapless numbers from 0 in the order of by.

    Rows are dealt by range, the counts of the ranges are added up, and rows are numbered within their range alone.
    """
    dealt = checkpointed(df.repartitionByRange(*by)).withColumn("_range", F.spark_partition_id())  # fixed by the checkpoint
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")  # a row a range
    starts = counts.select("_range", start.alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + within).cast("long")).drop("_range", "_start")
