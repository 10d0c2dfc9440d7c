"""Integer arrays as compressed bytes, and ranges of 64-bit hashes.

Counting over blocks: every block sends each of the ranges one message and gets
one back. blocks_of() keeps a message at MESSAGE values or more, so that the
number of messages grows with the data and not with the square of the blocks.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import zstandard
from pyspark import cloudpickle


def pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; sorted ones had better be differences."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


MESSAGE = 1_000  # values


def blocks_of(size: int, least: int) -> int:
    """How many blocks, and as many ranges: of least values each, or so many more that a message has MESSAGE of them."""
    return max(1, min(math.ceil(size / least), math.isqrt(size // MESSAGE)))


def bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of equal parts of the hash range begins in sorted keys."""
    edges = np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
