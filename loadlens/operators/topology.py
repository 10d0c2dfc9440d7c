"""Order of a process grid: corners, edges, faces, inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid_order(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(rank, place) of a row-major grid whose sides are at least 2.

    Cells are classed by the coordinates that lie on the border; edges go by
    their direction, faces by the axis that they cut, z first.
    """
    g = spark.range(nx * ny * nz).select(F.col("id").alias("rank"), F.expr(f"id % {nx}").alias("x"), F.expr(f"id div {nx} % {ny}").alias("y"), F.expr(f"id div {nx * ny}").alias("z"))
    edge = {a: F.col(a).isin(0, n - 1) for a, n in (("x", nx), ("y", ny), ("z", nz))}
    on = sum((edge[a].cast("int") for a in "xyz"), F.lit(0))
    kind = (
        F.when(on == 3, 0)
        .when((on == 2) & ~edge["x"], 1)
        .when((on == 2) & ~edge["y"], 2)
        .when(on == 2, 3)
        .when((on == 1) & edge["z"], 4)
        .when((on == 1) & edge["y"], 5)
        .when(on == 1, 6)
        .otherwise(7)
    )
    orders = {1: "yzx", 2: "xzy", 4: "zxy", 5: "yxz"}
    key = F.array("x", "y", "z")
    for k, order in orders.items():
        key = F.when(kind == k, F.array(*order)).otherwise(key)
    return g.select("rank", (F.row_number().over(Window.orderBy(kind, key)) - 1).cast("long").alias("place"))
