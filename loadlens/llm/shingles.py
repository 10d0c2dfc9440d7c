"""Word-shingle sets as 64-bit hashes, computed in Arrow batches.

The JVM has no rolling hash; one vectorised pass in numpy over the words of a
text costs a tenth of a lambda for every position. Words are hashed once and
remembered; five neighbours are mixed position by position.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

SHINGLE = 5
REMEMBERED_WORDS = 100_000  # some 20 MB of a Python worker


class WordHashes(dict):
    """64-bit hash of a word, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(z: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (Steele, Lea and Flood 2014)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: bytes | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (signed 64 bits).

    A-Z is lower-cased. With fewer than n words the whole sequence is the one
    shingle; without words the set is empty.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.int64)
    codes = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(n, len(found))
    count = len(found) - size + 1
    z = np.full(count, size, np.uint64)
    for i in range(size):
        z = mixed(z * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + count])
    return np.unique(z.view(np.int64))


def bottom_sketch(k: int):
    """UDF over UTF-8 bytes: set size, two sums that name the set, the k least hashes."""

    @F.pandas_udf("n long, sum_a long, sum_b long, sketch array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in batches:
            rows = []
            for text in texts:
                found = shingle_set(text, hashes)
                again = mixed(found.view(np.uint64) + np.uint64(1)).view(np.int64)
                rows.append((len(found), int(found.sum()), int(again.sum()), found[:k].copy()))
            yield pd.DataFrame(rows, columns=["n", "sum_a", "sum_b", "sketch"])

    return sketch


def full_set():
    """UDF over UTF-8 bytes: the whole sorted set."""

    @F.pandas_udf("array<long>")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([shingle_set(text, hashes) for text in texts], dtype=object)

    return whole


cloudpickle.register_pickle_by_value(sys.modules[__name__])
