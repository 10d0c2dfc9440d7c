"""Distances, k-medoids, linkage and comparison of clusterings.

Signatures that are clustered are few (a sample, or regions); what is assigned
to medoids may be any number and is joined to the k medoids.
"""

from __future__ import annotations

import math
import random
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.functions.scalars import euclidean

BLOCK = 1_000  # points of a block of pairs
SLICE = 250_000  # pairs that a task holds at a time
MOST_POINTS = 5_000  # of a distance matrix that is brought to the driver
MOST_TASKS = 10_000


def distances(x: np.ndarray, y: np.ndarray, how: str = "euclidean") -> np.ndarray:
    """Distances of all rows of x from all rows of y, added up a dimension at a time: no array is larger than the result."""
    out, off, other = np.zeros((len(x), len(y))), np.empty((len(x), len(y))), np.ascontiguousarray(y.T)
    for k in range(x.shape[1]):
        np.subtract(x[:, k, None], other[k], out=off)
        out += np.multiply(off, off, out=off) if how == "euclidean" else np.abs(off, out=off)
    return np.sqrt(out, out=out) if how == "euclidean" else out


def pair_distances(points: DataFrame, how: list[str], digits: int | None = None) -> DataFrame:
    """(a, b, and a column for each distance) for a < b of points(id, vals): a dissimilarity matrix, quadratic by nature.

    Any number of points: each pair of blocks of ids is a group of its own, its pairs leave by slices, so a task
    holds two blocks and a slice; points without vals have no pair. All distances are computed in one pass, and rounded half up if digits are given.
    """
    blocks = max(1, math.ceil(points.count() / BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = points.select("id", "vals", own.alias("own"), F.explode(places).alias("p")).select("id", "vals", "own", "p.i", "p.j")
    scale = digits is not None and 10.0**digits

    def pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = pd.concat(list(parts)).dropna(subset=["vals"])
        if not len(block):
            return
        first, second = (block[block["own"] == block[c].iloc[0]] for c in ("i", "j"))
        if not len(first) or not len(second):
            return
        (ids, x), (others, y) = ((side["id"].to_numpy(), np.stack(side["vals"].to_list())) for side in (first, second))
        same = block["i"].iloc[0] == block["j"].iloc[0]
        rows = max(1, SLICE // len(others))
        for k in range(0, len(ids), rows):
            own, part = ids[k : k + rows], x[k : k + rows]
            at, to = np.nonzero(np.less.outer(own, others) if same else np.not_equal.outer(own, others))
            found = {h: distances(part, y, h)[at, to] for h in how}
            if scale:
                found = {h: np.floor(v * scale + 0.5) / scale for h, v in found.items()}
            yield pd.DataFrame({"a": np.minimum(own[at], others[to]), "b": np.maximum(own[at], others[to]), **found})

    tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    return dealt.repartition(tasks, "i", "j").groupBy("i", "j").applyInPandas(pairs, "a long, b long, " + ", ".join(f"{h} double" for h in how))


def matrix_of(points: DataFrame, how: str = "euclidean") -> tuple[list, np.ndarray]:
    """Ids and distances of at most MOST_POINTS points, on the driver."""
    rows = points.select("id", "vals").orderBy("id").limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points: use clara()")
    return [r["id"] for r in rows], matrix(np.array([r["vals"] for r in rows], dtype=float).reshape(len(rows), -1), how)


def matrix(x: np.ndarray, how: str = "euclidean") -> np.ndarray:
    d = np.empty((len(x), len(x)))
    for i, row in enumerate(x):  # one row's differences at a time
        d[i] = np.sqrt(((row - x) ** 2).sum(-1)) if how == "euclidean" else np.abs(row - x).sum(-1)
    return d


def pam(d: np.ndarray, k: int) -> tuple[list[int], float]:
    """Medoids by building greedily and swapping while the cost falls (Kaufman and Rousseeuw 1990); ties to the least index."""
    n = len(d)
    k = min(k, n)
    medoids = [int(d.sum(1).argmin())]
    while len(medoids) < k:
        near = d[:, medoids].min(1)
        gain = np.maximum(near[:, None] - d, 0).sum(0)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
    cost = d[:, medoids].min(1).sum()
    while True:
        best = (cost - 1e-12, None)
        for i in range(k):
            rest = medoids[:i] + medoids[i + 1 :]
            near = d[:, rest].min(1) if rest else np.full(n, np.inf)
            costs = np.minimum(near[:, None], d).sum(0)
            costs[medoids] = np.inf
            j = int(costs.argmin())
            if costs[j] < best[0]:
                best = (costs[j], (i, j))
        if best[1] is None:
            return sorted(medoids), float(cost)
        cost, (i, j) = best
        medoids[i] = j


def bic(d: np.ndarray, medoids: list[int], dims: int) -> float:
    """Bayesian information criterion with one spherical variance (Pelleg and Moore 2000)."""
    return bic_of(d[:, medoids], dims)


def bic_of(d: np.ndarray, dims: int) -> float:
    """The criterion from the distances of all points from the medoids alone."""
    n, k = d.shape
    owner = d.argmin(1)
    squares = float((d.min(1) ** 2).sum())
    variance = max(squares / max((n - k) * dims, 1), 1e-12)
    out = 0.0
    for i in range(k):
        size = int((owner == i).sum())
        if size:
            out += size * math.log(size / n) - size * dims / 2 * math.log(2 * math.pi * variance) - (size - 1) * dims / 2
    return out - k * (dims + 1) / 2 * math.log(n)


def xpam(d: np.ndarray, k_max: int, dims: int) -> tuple[list[int], float]:
    """The number of medoids up to k_max with the best criterion."""
    tried = [(bic(d, m, dims), -k, m) for k in range(1, min(k_max, len(d)) + 1) for m in [pam(d, k)[0]]]
    best = max(tried)
    return best[2], best[0]


def assign(points: DataFrame, medoids: DataFrame) -> DataFrame:
    """points(id, vals) with their nearest of the k medoids(id, vals): each row holds all medoids as one array."""
    k = medoids.agg(F.sort_array(F.collect_list(F.struct("id", "vals"))).alias("m"))  # k rows
    nearest = F.array_min(F.transform("m", lambda m: F.struct(euclidean(m["vals"], F.col("vals")).alias("d"), m["id"].alias("medoid"))))
    return points.crossJoin(F.broadcast(k)).select("id", nearest["medoid"].alias("medoid"), nearest["d"].alias("d"))  # one row


def clara(spark: SparkSession, points: DataFrame, k: int, repeats: int = 5, size: int = 40, seed: int = 1, by_bic: bool = False) -> DataFrame:
    """(id, medoid, d): medoids of the best of some samples, all points assigned.

    Samples are the ids with the least hashes, so reruns agree; the driver
    holds size + 2 k points at a time.
    """
    best = None
    for r in range(repeats):
        rows = points.orderBy(F.xxhash64(F.lit(seed + r), "id"), "id").limit(size + 2 * k).collect()
        x = np.array([row["vals"] for row in rows], dtype=float)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        own = xpam(d, k, x.shape[1])[0] if by_bic else pam(d, k)[0]
        medoids = spark.createDataFrame([(rows[i]["id"], [float(v) for v in rows[i]["vals"]]) for i in own], "id long, vals array<double>")
        assigned = assign(points, medoids)
        cost = assigned.agg(F.sum("d")).first()[0]
        if best is None or cost < best[0]:
            best = (cost, assigned)
    return best[1]


def complete_linkage(ids: list, d: np.ndarray) -> list[tuple[int, int, int, float, int]]:
    """(step, left, right, height, size): clusters are numbered on from the points; ties to the least numbers."""
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    names, size, out = list(range(len(ids))), [1] * len(ids), []
    for step in range(len(ids) - 1):
        i, j = sorted(divmod(int(d.argmin()), len(d)))
        out.append((step, *sorted((names[i], names[j])), float(d[i, j]), size[i] + size[j]))
        merged = np.maximum(d[i], d[j])
        merged[[i, j]] = np.inf
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        names[i], size[i] = len(ids) + step, size[i] + size[j]
    return out


def flatten(merges: list[tuple], n: int, clusters: int) -> list[int]:
    """Cluster of each point after all but clusters - 1 merges, numbered by least point."""
    root = list(range(2 * n))
    for step, left, right, _, _ in merges[: max(n - clusters, 0)]:
        root[left] = root[right] = n + step

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    order: dict[int, int] = {}
    return [order.setdefault(top(i), len(order)) for i in range(n)]


def depth(merges: list[tuple], n: int) -> int:
    """Levels of a dendrogram."""
    at = [0] * (n + len(merges))
    for step, left, right, _, _ in merges:
        at[n + step] = 1 + max(at[left], at[right])
    return max(at, default=0)


def mirkin(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, distance, share): ordered pairs that one clustering joins and the other parts, from the contingency table alone."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    left = cells.groupBy(a).agg(F.sum("n").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("l"), F.sum("s").alias("n"))
    right = cells.groupBy(b).agg(F.sum("n").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("r"))
    return left.crossJoin(right).select("n", (F.col("l") + F.col("r") - 2 * both).alias("distance"), ((F.col("l") + F.col("r") - 2 * both) / (F.col("n") * F.col("n"))).alias("share"))


def expand(clusters: DataFrame, levels: int) -> DataFrame:
    """Each approximate point's cluster for its block of 2^levels processes."""
    s = 1 << levels
    return clusters.select(F.explode(F.sequence(F.col("id") * s, (F.col("id") + 1) * s - 1)).alias("id"), "cluster")


def seeded(seed: int) -> random.Random:
    return random.Random(seed)

cloudpickle.register_pickle_by_value(sys.modules[__name__])
