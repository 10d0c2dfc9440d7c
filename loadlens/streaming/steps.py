"""Progress steps over streams: the batch aggregates, kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_SECONDS = 12 * 3600


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """events as they arrive in a folder, ts in the session's time zone."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def step_totals(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(region, rank, step, v): tumbling steps; state is dropped once the watermark has passed a step."""
    marked = events.withWatermark("ts", late)
    grouped = marked.groupBy(F.window("ts", f"{STEP_SECONDS} seconds"), F.col("event_type").alias("region"), F.expr("user_id % 16").alias("rank")).agg(F.sum("value").alias("v"))
    step = F.floor((F.unix_seconds("window.start") - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / STEP_SECONDS)
    return grouped.select("region", "rank", step.cast("long").alias("step"), F.round("v", 4).alias("v"))


def run_to_table(frame: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drain what is there into an in-memory table, for tests and small results."""
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)


def with_listeners(frame: DataFrame, listeners: dict[str, tuple[int, Callable[[DataFrame, int], None]]], checkpoint: str, mode: str = "update"):
    """Call each listener(batch, id) every so many batches; registering a name again replaces it."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for every, call in listeners.values():
            if (number + 1) % every == 0:
                call(kept, number)
        kept.unpersist()

    return frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)


def append_trace(batch: DataFrame, path: str, number: int) -> None:
    """A step's records after those of the steps before; a batch that is run again replaces its own."""
    batch.select(F.lit(number).alias("batch"), F.concat(F.lit("    ["), "region", F.lit(" "), F.col("rank").cast("string"), F.lit("]"), F.col("v").cast("string")).alias("value")).write.mode("overwrite").parquet(f"{path}/batch={number}")


def elapsed_stream(events: DataFrame) -> DataFrame:
    """Keyed state for event-driven regions: the time since a rank's last event, and its path.

    events(rank, ts, path); within a batch a rank's events are put in order.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_ts, last_path, place = state.get if state.exists else (None, None, 0)
        rows = []
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            place += 1
            now = int(row.ts.value // 1000)
            if last_ts is not None:
                enter = place % 2 == 1
                rows.append((key[0], int(row.event_id), now - last_ts, last_path if enter else None, row.path if enter else None))
            last_ts, last_path = now, row.path
        state.update((last_ts, last_path, place))
        yield pd.DataFrame(rows, columns=["rank", "event_id", "elapsed", "start_path", "end_path"])

    return events.groupBy("rank").applyInPandasWithState(update, "rank long, event_id long, elapsed long, start_path string, end_path string", "ts long, path string, place long", "append", "NoTimeout")
