"""Regions of an effort log as a small database: what a viewer asks of it, each answer a DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.operators import cluster, wavelet
from loadlens.operators import densify as D
from loadlens.sources import store


class RegionDB:
    """cells(metric, the columns of region, rank, step, v) of matrices of one shape.

    region names the columns that tell regions apart, none of them null. A cell
    that is not there is 0; cells that stand twice are added up where they are
    summed, and must not stand twice for distances, coefficients and save().
    Nothing is read before an answer is asked for, and where() reaches the scan.
    """

    def __init__(self, cells: DataFrame, shape: tuple[int, int], region: tuple[str, ...] = ("region",)):
        self.cells, self.shape, self.region = cells.select("metric", *region, "rank", "step", "v"), shape, region

    @classmethod
    def load(cls, spark: SparkSession, path: str, shape: tuple[int, int], region: tuple[str, ...] = ("region",)) -> RegionDB:
        """What save() wrote."""
        return cls(D.to_long(store.read_effort(spark, path), ["metric", *region, "rank"]), shape, region)

    def save(self, path: str) -> None:
        """An effort store by metric, a row for each rank of a region that has a cell; steps outside the shape are not kept."""
        store.write_effort(D.sparse_to_rows(self.cells, ["metric", *self.region, "rank"], self.shape[1]), path)

    def where(self, condition: Column | str) -> RegionDB:
        """The regions, metrics or cells that meet a condition."""
        return RegionDB(self.cells.where(condition), self.shape, self.region)

    def metrics(self) -> DataFrame:
        """(metric, first): time is listed first."""
        return self.cells.select("metric").distinct().withColumn("first", F.col("metric") == "time").orderBy(F.col("metric") != "time", "metric")

    def regions(self) -> DataFrame:
        """(region, metrics): a region's metrics merged into one row."""
        return self.cells.groupBy(*self.region).agg(F.sort_array(F.collect_set("metric")).alias("metrics"))

    def totals(self, metric: str) -> DataFrame:
        """(region, total, percent of the metric), largest first."""
        summed = self._of(metric).groupBy(*self.region).agg(F.sum("v").alias("total"))
        whole = summed.agg(F.sum("total").alias("whole"))
        shared = summed.crossJoin(F.broadcast(whole))  # one row
        return shared.select(*self.region, "total", F.when(F.col("whole") != 0, 100 * F.col("total") / F.col("whole")).alias("percent")).orderBy(F.col("total").desc(), *self.region)

    def surface(self, metric: str) -> DataFrame:
        """(rank, step, v): all cells of the shape, the regions added up."""
        summed = self._of(metric).groupBy("metric", "rank", "step").agg(F.sum("v").alias("v"))
        return D.densify(summed, ["metric"], *self.shape).drop("metric")

    def matrices(self, metric: str) -> DataFrame:
        """(region, rank, step, v): every cell of every region."""
        return D.densify(self._of(metric).drop("metric"), list(self.region), *self.shape)

    def coefficients(self, metric: str, level: int) -> DataFrame:
        """(region, rank, step, v): the wavelet pyramid of every region."""
        keys = list(self.region)
        return D.to_long(wavelet.dwt2(D.to_rows(self.matrices(metric), [*keys, "rank"]), keys, level, self.shape), [*keys, "rank"])

    def distances(self, metric: str, level: int | None = None) -> DataFrame:
        """(a, b, rmse) of each two regions a < b: over their cells, or over their coefficients at a level.

        Regions are structs if several columns name them. Cells meet by place, so the join is an equi-join.
        """
        long = self.matrices(metric) if level is None else self.coefficients(metric, level)
        a, b = (long.select(self._id().alias(name), "rank", "step", F.col("v").alias(v)) for name, v in (("a", "x"), ("b", "y")))
        diff = F.col("x") - F.col("y")
        return a.join(b, ["rank", "step"]).where("a < b").groupBy("a", "b").agg(F.sqrt(F.avg(diff * diff)).alias("rmse"))

    def clusters(self, metric: str, n: int, level: int | None = None) -> list[tuple]:
        """(region, cluster) of at most n clusters by complete linkage, on the driver; above MOST_POINTS regions ValueError."""
        found = self._of(metric).select(self._id().alias("id")).distinct().limit(cluster.MOST_POINTS + 1).collect()
        ids = sorted(r["id"] for r in found)
        if len(ids) > cluster.MOST_POINTS:
            raise ValueError(f"more than {cluster.MOST_POINTS} regions")
        at, d = {x: i for i, x in enumerate(ids)}, np.zeros((len(ids), len(ids)))
        for r in self.distances(metric, level).collect():  # a row a pair of regions
            d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = r["rmse"]
        merges = cluster.complete_linkage(ids, d)
        return list(zip(ids, cluster.flatten(merges, len(ids), n), strict=True))

    def _of(self, metric: str) -> DataFrame:
        return self.cells.where(F.col("metric") == metric)

    def _id(self) -> Column:
        return F.col(self.region[0]) if len(self.region) == 1 else F.struct(*self.region)
