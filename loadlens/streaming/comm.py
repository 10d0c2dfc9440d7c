"""Attribution of time between enter and exit events to regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("effort", "comm", "both")


def collected(events: DataFrame, mode: str) -> DataFrame:
    """Events(kind, ...) of a collection mode; an invalid mode is effort."""
    mode = mode if mode in MODES else "effort"
    return events if mode == "both" else events.where(F.col("kind") == mode)


def comm_regions(events: DataFrame, rank: str = "rank", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """events(rank, ts, event_id, path) with the time since the one before and the region it goes to.

    Odd events of a rank enter communication: the time before belongs to
    (path before, path). Even ones leave it: the time belongs to (null, null).
    """
    w = Window.partitionBy(rank).orderBy(*order)
    at = events.withColumns({"place": F.row_number().over(w), "since": F.lag("ts").over(w), "last_path": F.lag("path").over(w)})
    enter = F.col("place") % 2 == 1
    us = F.expr("timestampdiff(MICROSECOND, since, ts)")
    return at.where("since is not null").select(rank, "ts", "event_id", us.alias("elapsed"), F.when(enter, F.col("last_path")).alias("start_path"), F.when(enter, F.col("path")).alias("end_path"))
