"""Whole effort logs as coded payloads, and back.

Compressing: the transform of each key's matrix, quantized and less its mean; blocks
of rows coded apart as they would lie on their processes, a task each; their runs merged without decompressing
them, and entropy coded: a row with the header and the payload for each key. Decompressing reads as many passes and undoes as many
levels as are asked for.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.functions.scalars import le_power_of_2, radix_preorder
from loadlens.operators import codec, wavelet

HEADER = "rows long, cols long, level long, mean long, scale long, threshold long, encoding string, blocks long, passes long, ezw_size long, rle_size long, enc_size long"


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def quantized(rows: DataFrame, keys: list[str], shape: tuple[int, int], level: int, scale: int) -> DataFrame:
    """(keys, rank, vals, mean, threshold): the whole transform as integers less their mean."""
    made = wavelet.dwt2(rows, keys, level, shape).select(*keys, "rank", F.transform("vals", lambda v: codec.quantize(v, scale)).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
    sums = made.groupBy(*keys).agg(F.round(F.sum(total) / (shape[0] * shape[1])).cast("long").alias("mean"), F.max(F.array_max("q")).alias("hi"), F.min(F.array_min("q")).alias("lo"))
    top = F.greatest(F.abs(F.col("hi") - F.col("mean")), F.abs(F.col("lo") - F.col("mean")))
    joined = made.join(sums.select(*keys, "mean", le_power_of_2(top).alias("threshold")), keys)
    return joined.select(*keys, "rank", F.transform("q", lambda x: x - F.col("mean")).alias("vals"), "mean", "threshold")


def compress(rows: DataFrame, keys: list[str], shape: tuple[int, int], level: int = -1, scale: int = 1024, passes: int = 0, blocks: int = 1, encoding: str = "huffman") -> DataFrame:
    """(keys, header, dominant, subordinate, payload) of rows(keys, rank, vals): the bits of each pass of all blocks.

    Both sides of a matrix, and the blocks, are powers of two; level -1 is all that a block's rows allow.
    """
    per = shape[0] // blocks
    if any(n & (n - 1) for n in (*shape, blocks)) or per < 2:
        raise ValueError(f"{shape[0]} rows, {shape[1]} columns and {blocks} blocks must be powers of two, with two rows a block")
    level = codec.resolve_level(level, per, shape[1])
    made = quantized(rows, keys, shape, level, scale)
    block, own = wavelet.block_row("rank", blocks, per, level)
    dealt = made.select(*keys, block.alias("block"), own.alias("own"), "vals", "mean", "threshold")

    def code(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("own")
        one = group.iloc[0]
        rle, size, bits = codec.encode_block(np.stack(group["vals"].to_list()), level, int(one["threshold"]), passes)
        return pd.DataFrame([[*(one[k] for k in keys), one["block"], one["mean"], one["threshold"], rle, size, [d for d, _ in bits], [s for _, s in bits]]], columns=[*keys, "block", "mean", "threshold", "rle", "ezw_size", "dominant", "subordinate"])

    names = _schema(rows, keys)
    coded = dealt.groupBy(*keys, "block").applyInPandas(code, f"{names}, block long, mean long, threshold long, rle binary, ezw_size long, dominant array<long>, subordinate array<long>")
    order = {b: i for i, b in enumerate(radix_preorder(blocks))}

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(place=group["block"].map(order)).sort_values("place")
        one = group.iloc[0]
        payload, rle_size = codec.finish([bytes(x) for x in group["rle"]], encoding)
        head = [*shape, level, one["mean"], scale, one["threshold"], encoding, blocks, len(one["dominant"]), int(group["ezw_size"].sum()), rle_size, len(payload)]
        bits = [np.sum(np.stack(group[c].to_list()), 0).tolist() for c in ("dominant", "subordinate")]
        return pd.DataFrame([[*(one[k] for k in keys), *head, *bits, payload]], columns=[*keys, *[x.split()[0] for x in HEADER.split(", ")], "dominant", "subordinate", "payload"])

    return coded.groupBy(*keys).applyInPandas(merge, f"{names}, {HEADER}, dominant array<long>, subordinate array<long>, payload binary")


def write_log(payloads: DataFrame, path: str) -> None:
    payloads.write.mode("overwrite").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Coded payloads; selecting the header alone leaves them unread."""
    return spark.read.parquet(path)


def coefficients(payloads: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    """(keys, rank, vals, mean, scale): integer coefficients, in their place in the whole transform, after limit passes (0: all)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.to_dict("records"):
                # More passes than the header's stay undecoded; all of them are coded if it says 0.
                made = codec.decode_payload(bytes(row["payload"]), row["rows"], row["cols"], row["level"], row["threshold"], row["passes"], row["rle_size"], row["encoding"], row["blocks"], limit)
                for block, part in zip(radix_preorder(row["blocks"]), made, strict=True):
                    own = np.arange(len(part)) + block * len(part)
                    yield pd.DataFrame({**{k: [row[k]] * len(part) for k in keys}, "own": own, "vals": list(part), **{c: row[c] for c in ("rows", "blocks", "level", "mean", "scale")}})

    kept = payloads.select(*keys, *[x.split()[0] for x in HEADER.split(", ")], "payload")
    made = kept.mapInPandas(decode, f"{_schema(payloads, keys)}, own long, vals array<long>, rows long, blocks long, level long, mean long, scale long")
    shapes = payloads.select("rows", "blocks", "level").distinct().collect()  # settings of the log
    rank = F.lit(None).cast("long")
    for s in shapes:
        same = (F.col("rows") == s.rows) & (F.col("blocks") == s.blocks) & (F.col("level") == s.level)
        rank = F.when(same, wavelet.reassembled_row("own", s.blocks, s.rows // s.blocks, s.level)).otherwise(rank)
    return made.select(*keys, rank.alias("rank"), "vals", "mean", "scale")


def reconstruct(payloads: DataFrame, keys: list[str], limit: int = 0, undo: int = -1) -> DataFrame:
    """(keys, rank, vals) after limit passes and undo inverse levels, all by default."""
    made = coefficients(payloads, keys, limit)
    value = F.transform("vals", lambda q: (q + F.col("mean")) / F.col("scale").cast("double"))
    rows = made.select(*keys, "rank", value.alias("vals"))
    out = []
    for s in payloads.select("rows", "cols", "level").distinct().collect():  # settings of the log
        own = rows.join(payloads.where((F.col("rows") == s.rows) & (F.col("cols") == s.cols) & (F.col("level") == s.level)).select(*keys), keys, "left_semi")
        out.append(wavelet.dwt2(own, keys, s.level, (s.rows, s.cols), s.level if undo < 0 else undo))
    return reduce(DataFrame.union, out) if out else rows


cloudpickle.register_pickle_by_value(sys.modules[__name__])
