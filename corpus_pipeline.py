"""From raw documents to sharded training data: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each as Parquet beside the checkpoints and rereads it as the next one's docs,
so that a lost executor costs a stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loadlens.llm import decontaminate, mixing, neardup, quality, sharding
from loadlens.llm.common import remove, shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules of their language and source go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target: documents come as often as the mix takes them."""
    return mixing.draw(docs)


def sharding_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; copies of a document share a shard."""
    return sharding.sharded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", sharding_rows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the shared folder of spark.checkpoint.dir holds what they write.

    What a stage wrote is deleted when the next one's rows are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def _over(sql: str, table_name: str) -> str:
    """A stage's SQL over another table than documents."""
    return sql.replace("FROM documents", f"FROM {table_name}")


#: The stages' own SQL, each over the rows that the one before left.
ORACLE_SQL = f"""
WITH p1 AS MATERIALIZED (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept)),
p2 AS MATERIALIZED (SELECT * FROM p1 WHERE doc_id IN (SELECT doc_id FROM ({_over(neardup.ORACLE_SQL, "p1")}) WHERE kept)),
p3 AS MATERIALIZED (SELECT * FROM p2 WHERE doc_id NOT IN (SELECT doc_id FROM ({_over(decontaminate.ORACLE_SQL, "p2")}))),
m AS MATERIALIZED ({_over(mixing.ORACLE_SQL, "p3")}),
p4 AS MATERIALIZED (SELECT p3.* FROM (SELECT doc_id, unnest(range(taken // size)) AS copy FROM m WHERE size > 0) c JOIN p3 ON p3.doc_id = c.doc_id)
SELECT * FROM ({sharding.oracle("p4", ("text", "lang", "source", "n_chars"))})"""
