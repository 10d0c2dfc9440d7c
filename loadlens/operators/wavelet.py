"""CDF 9/7 wavelet transforms over arrays, over long tables, and of matrices.

Arrays go through a numpy kernel in Arrow batches: a batch of rows is one
matrix, so a lifting step is a few vector operations. The long form uses lag
and lead over one window and stays on the JVM.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.operators.checkpoints import checkpointed
from loadlens.operators.densify import transpose

#: Lifting steps and scale of the CDF 9/7 transform.
LIFT = (-1.5861343420693648, -0.0529801185718856, 0.8829110755411875, 0.4435068520511142)
SCALE = 1.1496043988602418
#: Half of each symmetric filter of the same transform, outermost tap first.
LOW_HALF = (0.026748757411, -0.016864118443, -0.078223266529, 0.266864118443, 0.602949018236)
HIGH_HALF = (0.0, 0.045635881557, -0.028771763114, -0.295635881557, 0.557543526229)


def taps(half: tuple, alternate: bool = False) -> list[float]:
    """All nine taps, scaled by the root of two; alternate flips every other sign."""
    whole = [*half, *half[-2::-1]]
    return [t * 2**0.5 * (-1 if alternate and i % 2 else 1) for i, t in enumerate(whole)]


def max_level(n: int) -> int:
    return max(n, 1).bit_length() - 1


def _neighbours(x: np.ndarray, of: int) -> np.ndarray:
    """Sum of both neighbours of the even (0) or odd (1) places, reflected at the ends."""
    even, odd = x[..., ::2], x[..., 1::2]
    if of:
        return even + np.concatenate([even[..., 1:], even[..., -1:]], -1)
    return odd + np.concatenate([odd[..., :1], odd[..., :-1]], -1)


def forward_once(x: np.ndarray) -> np.ndarray:
    """One level along the last axis: low half, then high half."""
    x = x.astype(np.float64, copy=True)
    for step, a in enumerate(LIFT):
        of = 1 - step % 2
        x[..., of::2] += a * _neighbours(x, of)
    return np.concatenate([x[..., ::2] * SCALE, x[..., 1::2] / SCALE], -1)


def inverse_once(c: np.ndarray) -> np.ndarray:
    half = c.shape[-1] // 2
    x = np.empty(c.shape)
    x[..., ::2], x[..., 1::2] = c[..., :half] / SCALE, c[..., half:] * SCALE
    for step in reversed(range(4)):
        of = 1 - step % 2
        x[..., of::2] -= LIFT[step] * _neighbours(x, of)
    return x


def forward(x: np.ndarray, level: int = -1) -> np.ndarray:
    """Several levels along the last axis; -1 is all of them."""
    n = x.shape[-1]
    level = max_level(n) if level < 0 else level
    if n % (1 << level):
        raise ValueError(f"length {n} is not divisible by 2^{level}")
    x = x.astype(np.float64, copy=True)
    for k in range(level):
        x[..., : n >> k] = forward_once(x[..., : n >> k])
    return x


def inverse(c: np.ndarray, level: int = -1, undo: int = -1) -> np.ndarray:
    """Undo the last levels first; all by default."""
    n = c.shape[-1]
    level = max_level(n) if level < 0 else level
    undo = level if undo < 0 else min(undo, level)
    c = c.astype(np.float64, copy=True)
    for k in range(level - 1, level - 1 - undo, -1):
        c[..., : n >> k] = inverse_once(c[..., : n >> k])
    return c


def direct_once(x: np.ndarray) -> np.ndarray:
    """One level by convolution with reflected ends; equals lifting to about 1e-10."""
    n = x.shape[-1]
    at = np.abs((np.arange(n)[:, None] + np.arange(-4, 6)[None, :]))
    period = max(2 * (n - 1), 1)
    at = at % period
    around = x[..., np.minimum(at, period - at)]
    low = around[..., ::2, :9] @ np.array(taps(LOW_HALF))
    high = around[..., ::2, 1:10] @ np.array(taps(HIGH_HALF))
    return np.concatenate([low, high], -1)


def direct_inverse_once(c: np.ndarray) -> np.ndarray:
    """The inverse filters over the interleaved halves."""
    n, half = c.shape[-1], c.shape[-1] // 2
    x = np.empty(c.shape)
    x[..., ::2], x[..., 1::2] = c[..., :half], c[..., half:]
    period = max(2 * (n - 1), 1)
    at = np.abs(np.arange(n)[:, None] + np.arange(-4, 5)[None, :]) % period
    around = x[..., np.minimum(at, period - at)]
    odd = (np.arange(n)[:, None] + np.arange(9)[None, :]) % 2 == 1
    weight = np.where(odd, np.array(taps(LOW_HALF, True))[None, :], np.array(taps(HIGH_HALF, True))[None, :])
    return (around * weight).sum(-1)


def level_matrix(n: int, level: int) -> np.ndarray:
    """W with coefficients = W x: the transform is linear."""
    return forward(np.eye(n), level).T


def forward2(m: np.ndarray, level: int = -1) -> np.ndarray:
    """Matrix pyramid: rows, then columns, then both dimensions halve; a dimension stops at 1."""
    m = m.astype(np.float64, copy=True)
    rows, cols = m.shape
    for _ in range(max_level(min(rows, cols)) if level < 0 else level):
        if cols > 1:
            m[:rows, :cols] = forward_once(m[:rows, :cols])
        if rows > 1:
            m[:rows, :cols] = forward_once(m[:rows, :cols].T).T
        rows, cols = max(rows // 2, 1), max(cols // 2, 1)
    return m


def inverse2(c: np.ndarray, level: int = -1, undo: int = -1) -> np.ndarray:
    c = c.astype(np.float64, copy=True)
    level = max_level(min(c.shape)) if level < 0 else level
    undo = level if undo < 0 else min(undo, level)
    for k in range(level - 1, level - 1 - undo, -1):
        rows, cols = max(c.shape[0] >> k, 1), max(c.shape[1] >> k, 1)
        if rows > 1:
            c[:rows, :cols] = inverse_once(c[:rows, :cols].T).T
        if cols > 1:
            c[:rows, :cols] = inverse_once(c[:rows, :cols])
    return c


def _by_length(vals: pd.Series, f) -> pd.Series:
    """Apply a kernel to all arrays of one length at once."""
    out = pd.Series([None] * len(vals), index=vals.index, dtype=object)
    size = vals.map(len)
    for n in size.unique():
        own = size[size == n].index
        if n:
            made = f(np.stack(vals[own].to_list()))
            for i, row in zip(own, made, strict=True):
                out[i] = row
        else:
            for i in own:
                out[i] = np.empty(0)
    return out


def dwt(vals: Column, level: int = -1) -> Column:
    """Forward transform of an array column."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return _by_length(v, lambda x: forward(x, level))

    return run(vals)


def idwt(vals: Column, level: int = -1, undo: int = -1) -> Column:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return _by_length(v, lambda x: inverse(x, level, undo))

    return run(vals)


def dwt_direct(vals: Column) -> Column:
    """One level by convolution."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return _by_length(v, direct_once)

    return run(vals)


def idwt_direct(vals: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return _by_length(v, direct_inverse_once)

    return run(vals)


def signature(vals: Column, n: int, level: int | None = None) -> Column:
    """Low band of the transform; 16 elements unless a level is given."""
    level = max(max_level(n) - 4, 0) if level is None else level
    return F.slice(dwt(vals, level), 1, n >> level)


def lift_long(df: DataFrame, parts: list[str], at: str, n: int) -> DataFrame:
    """One forward level of a long table (parts, at, v), each part n long.

    Four window steps share one sort and one shuffle.
    """
    w = Window.partitionBy(*parts).orderBy(at)
    out = df
    for step, a in enumerate(LIFT):
        lag, lead = F.lag("v").over(w), F.lead("v").over(w)
        moved = F.col("v") + a * (F.coalesce(lag, lead) + F.coalesce(lead, lag))
        out = out.withColumn("v", F.when(F.col(at) % 2 == 1 - step % 2, moved).otherwise(F.col("v")))
    odd = F.col(at) % 2 == 1
    return out.withColumn("v", F.when(odd, F.col("v") / SCALE).otherwise(F.col("v") * SCALE)).withColumn(at, F.when(odd, F.expr(f"{n} div 2 + {at} div 2")).otherwise(F.expr(f"{at} div 2")))


def dwt2_small(rows: DataFrame, keys: list[str], level: int = -1, undo: int | None = None) -> DataFrame:
    """Whole pyramid of each key's matrix in one task; for matrices of some megabytes.

    rows(keys, rank, vals); undo gives the number of inverse levels instead.
    """
    names = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        m = np.stack(group["vals"].to_list())
        made = forward2(m, level) if undo is None else inverse2(m, level, undo)
        return group.assign(vals=list(made))[[*keys, "rank", "vals"]]

    return rows.select(*keys, "rank", "vals").groupBy(*keys).applyInPandas(run, f"{names}, rank long, vals array<double>")


def dwt2_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One level of matrices of any height: rows in batches, a transpose, columns in batches, a transpose back."""

    @F.pandas_udf("array<double>")
    def once(v: pd.Series) -> pd.Series:
        return _by_length(v, forward_once)

    across = rows.withColumn("vals", once("vals"))
    down = transpose(across, keys, "rank", "step").withColumn("vals", once("vals"))
    return transpose(down, keys, "step", "rank")


CELLS = 4_000_000  # of a matrix that one task transforms


def _part(vals, start: int, n: int) -> Column:
    return F.slice(vals, start + 1, n)


def _piece(rows: DataFrame, keys: list[str], at: int, vals: Column) -> DataFrame:
    return rows.select(*keys, "rank", F.lit(at).alias("at"), vals.alias("vals"))


def dwt2_large(rows: DataFrame, keys: list[str], level: int, shape: tuple[int, int]) -> DataFrame:
    """The pyramid of matrices of any size: each level transforms the low band of the one before alone.

    Rows and columns are arrays of their own, so a task needs no more than some of them. What a
    level leaves as detail is put aside and meets its row again at the end, by one shuffle.
    """
    pieces, low = [], rows.select(*keys, "rank", "vals")
    for k in range(level):
        r, c = shape[0] >> k, shape[1] >> k
        one = checkpointed(dwt2_once(low, keys))
        upper = one.where(F.col("rank") < r // 2)
        pieces += [_piece(one.where(F.col("rank") >= r // 2), keys, 0, F.col("vals")), _piece(upper, keys, c // 2, _part("vals", c // 2, c // 2))]
        low = upper.select(*keys, "rank", _part("vals", 0, c // 2).alias("vals"))
    pieces.append(_piece(low, keys, 0, F.col("vals")))
    every = reduce(DataFrame.union, pieces).groupBy(*keys, "rank").agg(F.sort_array(F.collect_list(F.struct("at", "vals"))).alias("p"))  # level + 1 at most
    return every.select(*keys, "rank", F.flatten("p.vals").alias("vals"))


def idwt2_large(rows: DataFrame, keys: list[str], level: int, shape: tuple[int, int], undo: int = -1) -> DataFrame:
    """The last undo levels inverted, all by default; the other rows and columns stay."""
    undo = level if undo < 0 else min(undo, level)

    def put(low: DataFrame, into: DataFrame, c: int, width: int) -> DataFrame:
        """Rows with their first c values from low."""
        both = into.join(low.withColumnRenamed("vals", "low"), [*keys, "rank"], "left")
        return both.select(*keys, "rank", F.when(F.col("low").isNull(), F.col("vals")).otherwise(F.concat("low", _part("vals", c, width - c))).alias("vals"))

    @F.pandas_udf("array<double>")
    def once(v: pd.Series) -> pd.Series:
        return _by_length(v, inverse_once)

    low, size = None, None
    for k in range(level - 1, level - 1 - undo, -1):
        r, c = shape[0] >> k, shape[1] >> k
        band = rows.where(F.col("rank") < r).select(*keys, "rank", _part("vals", 0, c).alias("vals"))
        band = band if low is None else put(low, band, c // 2, c)
        up = transpose(band, keys, "rank", "step").withColumn("vals", once("vals"))
        low, size = checkpointed(transpose(up, keys, "step", "rank").withColumn("vals", once("vals"))), c
    rows = rows.select(*keys, "rank", "vals")
    return rows if low is None else put(low, rows, size, shape[1])


def dwt2(rows: DataFrame, keys: list[str], level: int, shape: tuple[int, int], undo: int | None = None) -> DataFrame:
    """The pyramid of each key's matrix of this shape, or its inverse: in one task up to CELLS, distributed beyond."""
    if shape[0] * shape[1] <= CELLS:
        return dwt2_small(rows, keys, level, undo)
    return dwt2_large(rows, keys, level, shape) if undo is None else idwt2_large(rows, keys, level, shape, undo)


def auto_level(rows_per_block: int) -> int:
    """Levels while the local rows stay above 5."""
    level = 0
    while rows_per_block > 5 and rows_per_block % 2 == 0:
        rows_per_block //= 2
        level += 1
    return level


def low_bands(cells: DataFrame, rows: int, cols: int, level: int, keep: int) -> DataFrame:
    """Coefficients (rank, step) that an approximation by keep inverse levels needs: a filter before any inverse."""
    return cells.where((F.col("rank") < ((rows >> level) << keep)) & (F.col("step") < ((cols >> level) << keep)))


def reassembled_row(row, blocks: int, per_block: int, level: int) -> Column:
    """Where a row of blockwise transformed coefficients stands in the whole transform."""
    row = F.col(row) if isinstance(row, str) else row
    block, own = F.floor(row / per_block), row % per_block
    low = per_block >> level
    out = block * low + own
    for k in range(level, 0, -1):
        half = per_block >> k
        out = F.when(own >= half, blocks * half + block * half + own - half).otherwise(out)
    return out.cast("long")


def block_row(place, blocks: int, per_block: int, level: int) -> tuple[Column, Column]:
    """The block, and the row in it, of a row of the whole transform: the inverse of reassembled_row()."""
    place = F.col(place) if isinstance(place, str) else place
    low = per_block >> level
    block, own = F.floor(place / low), place % low
    for k in range(level, 0, -1):
        half = per_block >> k
        past = place - blocks * half
        block = F.when(past >= 0, F.floor(past / half)).otherwise(block)
        own = F.when(past >= 0, half + past % half).otherwise(own)
    return block.cast("long"), own.cast("long")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
