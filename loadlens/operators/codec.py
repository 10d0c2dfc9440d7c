"""Quantization, bit planes, zerotrees and byte codecs."""

from __future__ import annotations

import heapq
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import takewhile

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions.scalars import le_power_of_2


def quantize(v, scale: int) -> Column:
    """Half away from zero; NaN is 0."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(F.isnan(v), 0).otherwise(F.round(v * scale)).cast("long")


def centered(cells: DataFrame, keys: list[str], q: str = "q") -> DataFrame:
    """q less its key's rounded mean, with the mean and the threshold of the key."""
    means = cells.groupBy(*keys).agg(F.round(F.avg(q)).cast("long").alias("mean"), F.max(q).alias("_hi"), F.min(q).alias("_lo"))
    top = F.greatest(F.abs(F.col("_hi") - F.col("mean")), F.abs(F.col("_lo") - F.col("mean")))
    means = means.select(*keys, "mean", le_power_of_2(top).alias("threshold"))
    return cells.join(means, keys).withColumn(q, F.col(q) - F.col("mean"))


def _right(x: Column, n: int) -> Column:
    return F.call_function("shiftright", x, F.lit(n))


def truncate_passes(q, threshold, passes: int) -> Column:
    """What a decoder has after so many passes; 0 passes are all."""
    q, threshold = (F.col(c) if isinstance(c, str) else c for c in (q, threshold))
    if passes <= 0:
        return q
    lowest, step = _right(threshold, passes - 1), _right(threshold, passes)
    size = F.abs(q)
    kept = F.when(step > 0, size - size % F.greatest(step, F.lit(1))).otherwise(size)
    return F.when(lowest == 0, q).when(size < lowest, F.lit(0).cast("long")).otherwise(F.signum(q).cast("long") * kept)


def dequantize(q, mean, scale: int) -> Column:
    return (F.col(q) + F.col(mean)) / float(scale)


def resolve_level(level: int, rows: int, cols: int) -> int:
    """Levels below 1 mean all; others are capped. Matrices without a level are rejected."""
    most = min(rows, cols).bit_length() - 1
    if most < 1:
        raise ValueError("a matrix of one row or column has no zerotree")
    return most if level < 1 else min(level, most)


def parent_of(row: int, col: int, rows: int, cols: int, level: int) -> tuple[int, int] | None:
    """Parent of a coefficient in the zerotree; None for the low band."""
    low_r, low_c = rows >> level, cols >> level
    if row < low_r and col < low_c:
        return None
    if row < 2 * low_r and col < 2 * low_c:
        return row % low_r, col % low_c
    return row // 2, col // 2


def parents(cells: DataFrame, rows: int, cols: int, level: int) -> DataFrame:
    """cells(rank, step) with parent_rank and parent_step; null for the low band."""
    low_r, low_c = rows >> level, cols >> level
    r, c = F.col("rank"), F.col("step")
    low = (r < low_r) & (c < low_c)
    first = (r < 2 * low_r) & (c < 2 * low_c)
    pick = lambda x, size: F.when(low, F.lit(None)).when(first, x % size).otherwise(F.floor(x / 2)).cast("long")
    return cells.withColumns({"parent_rank": pick(r, low_r), "parent_step": pick(c, low_c)})


def zerotree(cells: DataFrame, keys: list[str], rows: int, cols: int, level: int) -> DataFrame:
    """cells(keys, rank, step, q) with tree: the leading bits of a cell and all below it, ORed.

    Every cell is sent to its ancestors, at most log2(rows) of them, and one
    aggregate ORs them: a single shuffle, no loop over levels.
    """
    low_r, low_c = rows >> level, cols >> level
    bit = le_power_of_2(F.abs("q"))
    # Ancestors of the same orientation: halve until the first detail band, then the low band.
    chain = F.transform(F.sequence(F.lit(0), F.lit(level)), lambda k: F.struct(F.call_function("shiftright", F.col("rank"), k).alias("r"), F.call_function("shiftright", F.col("step"), k).alias("c")))
    inside = lambda x: (x["r"] >= low_r) | (x["c"] >= low_c)
    up = F.filter(chain, inside)
    root = F.element_at(up, -1)
    low = F.array(F.struct((root["r"] % low_r).alias("r"), (root["c"] % low_c).alias("c")))
    own = F.array(F.struct(F.col("rank").alias("r"), F.col("step").alias("c")))
    places = F.when(F.size(up) == 0, own).otherwise(F.concat(up, low))
    sent = cells.select(*keys, bit.alias("bit"), F.explode(places).alias("p"))
    trees = sent.groupBy(*keys, F.col("p.r").alias("rank"), F.col("p.c").alias("step")).agg(F.bit_or("bit").alias("tree"))
    return cells.join(trees, [*keys, "rank", "step"])


def dominant_symbol(q, tree, threshold: Column) -> Column:
    """P and N where the leading bit is the threshold's, T where nothing below reaches it, Z otherwise."""
    q, tree = F.col(q), F.col(tree)
    size = F.abs(q)
    own = (size >= threshold) & (size < 2 * threshold)
    return F.when(own & (q > 0), "P").when(own, "N").when(tree.bitwiseAND(threshold) == 0, "T").otherwise("Z")


# ---- bytes ----------------------------------------------------------------


def visit_order(rows: int, cols: int, level: int) -> list[tuple[int, int, int]]:
    """(row, col, size of its subtree) depth first from the low band."""
    low_r, low_c = rows >> level, cols >> level

    def children(r: int, c: int) -> list[tuple[int, int]]:
        if r < low_r and c < low_c:
            return [(r, c + low_c), (r + low_r, c), (r + low_r, c + low_c)]
        if 2 * r >= rows or 2 * c >= cols:
            return []
        return [(2 * r, 2 * c), (2 * r, 2 * c + 1), (2 * r + 1, 2 * c), (2 * r + 1, 2 * c + 1)]

    out: list[list[int]] = []

    def walk(r: int, c: int) -> None:
        at = len(out)
        out.append([r, c, 0])
        for x, y in children(r, c):
            walk(x, y)
        out[at][2] = len(out) - at

    for r in range(low_r):
        for c in range(low_c):
            walk(r, c)
    return [tuple(x) for x in out]


class Tree:
    """The coefficients of a matrix in visiting order: places, parents and where each subtree ends."""

    def __init__(self, rows: int, cols: int, level: int):
        self.shape = rows, cols
        low_r, low_c = rows >> level, cols >> level
        r, c = (x.ravel() for x in np.mgrid[:rows, :cols])
        # A cell's depth: how often its place is halved until it lies in the first detail bands.
        depth = np.zeros(len(r), np.int64)
        for d in range(level, 0, -1):
            depth[(r < low_r << d) & (c < low_c << d)] = d
        depth[(r < low_r) & (c < low_c)] = 0
        up = np.maximum(depth - 1, 0)
        top_r, top_c = r >> up, c >> up
        root = (top_r % low_r) * low_c + top_c % low_c
        band = np.where(depth == 0, 0, 2 * (top_r >= low_r) + (top_c >= low_c))
        # Preorder: by root, band and the two bits of each halving, a parent's missing bits before all of its children's.
        key = root * 4 + band
        for k in range(1, level):
            down = np.maximum(depth - 1 - k, 0)
            key = key * 5 + np.where(depth > k, 1 + 2 * ((r >> down) & 1) + ((c >> down) & 1), 0)
        order = np.argsort(key, kind="stable")
        self.at = order
        self.depth = depth[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pr = np.where(depth == 0, r, np.where(depth == 1, r % low_r, r >> 1))
        pc = np.where(depth == 0, c, np.where(depth == 1, c % low_c, c >> 1))
        self.parent = place[pr * cols + pc][order]
        sizes = np.ones(len(order), np.int64)
        for d in range(level, 0, -1):
            own = np.nonzero(self.depth == d)[0]
            np.add.at(sizes, self.parent[own], sizes[own])
        self.end = np.arange(len(order)) + sizes

    def below(self, bits: np.ndarray) -> np.ndarray:
        """OR of each cell's bits and of all below it."""
        out = bits.copy()
        for d in range(int(self.depth.max(initial=0)), 0, -1):
            own = np.nonzero(self.depth == d)[0]
            np.bitwise_or.at(out, self.parent[own], out[own])
        return out


#: The two bits of a zerotree, of a zero above others, and of new negative and positive values.
T, Z, N, P = 0, 1, 2, 3


def leading_bits(size: np.ndarray) -> np.ndarray:
    """The greatest power of two that is not above each value; 0 for 0."""
    out = size.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out |= out >> shift
    return out - (out >> 1)


def ezw_encode(q: np.ndarray, level: int, passes: int = 0, top: int | None = None) -> tuple[bytes, list[tuple[int, int]]]:
    """Embedded zerotree bits of an integer matrix, and the bits of each pass: dominant, subordinate.

    A dominant pass at threshold t visits the low band, what lies right below it, and whatever
    hangs on a visited cell with a leading bit t at or below it; two bits each. A subordinate pass sends the next bit
    of all values found so far, in the order in which they were found; there is none below the last threshold.
    top is the first threshold, the matrix's own unless it is part of a larger one.
    """
    tree = Tree(*q.shape, level)
    flat = q.ravel()[tree.at].astype(np.int64)
    size = np.abs(flat)
    lead = leading_bits(size)
    below = tree.below(lead)
    threshold = int(lead.max(initial=0)) if top is None else top
    found, bits, sizes = np.empty(0, np.int64), [], []
    while threshold and (not passes or len(sizes) < passes):
        seen = np.nonzero((tree.depth <= 1) | (below[tree.parent] & threshold != 0))[0]
        new = lead[seen] == threshold
        code = np.where(new, np.where(flat[seen] > 0, P, N), np.where(below[seen] & threshold != 0, Z, T))
        bits.append(np.stack([code >> 1, code & 1], 1).ravel().astype(np.uint8))
        found = np.concatenate([found, seen[new]])
        threshold >>= 1
        more = (size[found] & threshold != 0).astype(np.uint8) if threshold else np.empty(0, np.uint8)
        bits.append(more)
        sizes.append((2 * len(seen), len(more)))
    return np.packbits(np.concatenate([np.empty(0, np.uint8), *bits])).tobytes(), sizes


def ezw_decode(data: bytes, rows: int, cols: int, level: int, top: int, passes: int) -> tuple[np.ndarray, int]:
    """The matrix that so many passes of ezw_encode() give (0: all), and the bytes that they take."""
    tree = Tree(rows, cols, level)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    codes = (2 * bits[:-1] + bits[1:]).tolist() if len(bits) else []
    end, depth = tree.end.tolist(), tree.depth.tolist()
    size, sign = np.zeros(len(tree.at), np.int64), np.ones(len(tree.at), np.int64)
    found: list[int] = []
    at, threshold, done = 0, top, 0
    while threshold and (not passes or done < passes):
        i, new, negative = 0, [], []
        while i < len(end):
            code = codes[at]
            at += 2
            if code == T and depth[i]:
                i = end[i]
                continue
            if code >= N:
                new.append(i)
                if code == N:
                    negative.append(i)
            i += 1
        size[new] = threshold
        sign[negative] = -1
        found += new
        threshold >>= 1
        if threshold:
            size[found] |= bits[at : at + len(found)].astype(np.int64) * threshold
            at += len(found)
        done += 1
    out = np.zeros(rows * cols, np.int64)
    out[tree.at] = size * sign
    return out.reshape(rows, cols), -(-at // 8)


def least_common_byte(data: bytes) -> int:
    """The byte that occurs least; the smallest of those."""
    counts = Counter(data)
    return min(range(256), key=lambda b: (counts[b], b))


def runs(data: bytes) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b in data:
        if out and out[-1][0] == b:
            out[-1] = (b, out[-1][1] + 1)
        else:
            out.append((b, 1))
    return out


RUN_MOST = 32768


def rle_encode(data: bytes) -> bytes:
    """The marker first; runs of four and more as marker, length - 1 in one or two bytes, byte; marker bytes as marker, count - 1."""
    return rle_written(runs(data), least_common_byte(data)) if data else b""


def rle_written(found: list[tuple[int, int]], marker: int) -> bytes:
    """A stream of some runs."""
    out = bytearray([marker])
    for byte, total in found:
        while total:
            n = min(total, RUN_MOST)
            total -= n
            if byte == marker and n <= 3:
                out += bytes([marker, n - 1])
            elif byte == marker or n > 3:
                m = n - 1
                out += bytes([marker, m, byte]) if m < 128 else bytes([marker, 128 | (m >> 8), m & 255, byte])
            else:
                out += bytes([byte]) * n
    return bytes(out)


def rle_decode(data: bytes) -> bytes:
    if not data:
        return b""
    marker, at, out = data[0], 1, bytearray()
    while at < len(data):
        if data[at] != marker:
            out.append(data[at])
            at += 1
            continue
        m = data[at + 1]
        if m <= 2:
            out += bytes([marker]) * (m + 1)
            at += 2
        elif m < 128:
            out += bytes([data[at + 2]]) * (m + 1)
            at += 3
        else:
            out += bytes([data[at + 3]]) * ((((m & 127) << 8) | data[at + 2]) + 1)
            at += 4
    return bytes(out)


def rle_runs(stream: bytes) -> list[tuple[int, int]]:
    """(byte, count) of a stream's records, which are not decompressed."""
    out, at = [], 1
    while at < len(stream):
        if stream[at] != stream[0]:
            out.append((stream[at], 1))
            at += 1
            continue
        m = stream[at + 1]
        if m <= 2:
            out.append((stream[0], m + 1))
            at += 2
        elif m < 128:
            out.append((stream[at + 2], m + 1))
            at += 3
        else:
            out.append((stream[at + 3], (((m & 127) << 8) | stream[at + 2]) + 1))
            at += 4
    return out


def rle_histogram(streams: list[bytes]) -> Counter:
    """How often each byte stands in what some streams hold."""
    out: Counter = Counter()
    for stream in streams:
        for byte, n in rle_runs(stream):
            out[byte] += n
    return out


def joined_runs(streams: list[bytes]) -> list[tuple[int, int]]:
    """The runs of several streams one after another; those that meet at an end are one."""
    out: list[tuple[int, int]] = []
    for stream in streams:
        for byte, n in rle_runs(stream):
            if out and out[-1][0] == byte:
                out[-1] = byte, out[-1][1] + n
            else:
                out.append((byte, n))
    return out


def rle_merge(parts: list[bytes]) -> bytes:
    """One stream for several, run by run under the marker of all; nothing is decompressed."""
    found = joined_runs(parts)
    counts = rle_histogram(parts)
    return rle_written(found, min(range(256), key=lambda b: (counts[b], b))) if found else b""


class Bits:
    """A writer of codes, most significant bit first."""

    def __init__(self):
        self.parts: list[str] = []

    def put(self, value: int, width: int) -> None:
        self.parts.append(format(value, f"0{width}b"))

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        size = -(-len(text) // 8)
        return int(text.ljust(8 * size, "0") or "0", 2).to_bytes(size, "big")


def huffman_tree(counts: dict[int, int]):
    """Nested pairs of symbols; the two lightest are joined first, ties by what was made first."""
    heap = [(n, i, s) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, (a[2], b[2])))
        made += 1
    return heap[0][2]


def huffman_codes(tree) -> dict[int, tuple[int, int]]:
    """(code, width) of each symbol; a tree of one symbol spends a bit on each."""
    out, todo = {}, [(tree, 0, 0)]
    while todo:
        node, code, width = todo.pop()
        if isinstance(node, tuple):
            todo += [(node[0], 2 * code, width + 1), (node[1], 2 * code + 1, width + 1)]
        else:
            out[node] = code, max(width, 1)
    return out


def huffman_encode(data: bytes) -> bytes:
    """The tree in preorder, 0 for a node, 1 and eight bits for a leaf, then the codes. The size of data is not in it."""
    if not data:
        return b""
    tree, bits, todo = huffman_tree(Counter(data)), Bits(), []
    todo.append(tree)
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            bits.put(0, 1)
            todo += [node[1], node[0]]
        else:
            bits.put(256 | node, 9)
    codes = {s: format(code, f"0{width}b") for s, (code, width) in huffman_codes(tree).items()}
    bits.parts.append("".join(map(codes.__getitem__, data)))
    return bits.bytes()


def huffman_decode(data: bytes, size: int) -> bytes:
    """size bytes from what huffman_encode() made of them."""
    if not size:
        return b""
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    at = 0

    def read():
        nonlocal at
        at += 1
        if bits[at - 1] == 0:
            return read(), read()
        at += 8
        return int("".join(map(str, bits[at - 8 : at])), 2)

    tree = read()
    if not isinstance(tree, tuple):
        return bytes([tree]) * size
    out, node = bytearray(), tree
    while len(out) < size:
        node = node[bits[at]]
        at += 1
        if not isinstance(node, tuple):
            out.append(node)
            node = tree
    return bytes(out)


_TOP, _HALF, _QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30


class Model:
    """Counts of some symbols, bytes or bits or any others, with their sums in a binary indexed tree.

    An adaptive model adds step to a symbol's count when it has seen it; with a
    step of 0 the model is static. Both sides of a code start from equal models.
    """

    def __init__(self, counts: list[int], step: int = 0):
        if not counts or min(counts) < 0 or not 0 < sum(counts) < _QUARTER:
            raise ValueError("counts must not be negative, nor their sum 0 or 2^30 and more")
        self.step = step
        self.set(list(counts))

    def set(self, n: list[int]) -> None:
        self.n, self.all, self.sums = n, sum(n), [0, *n]
        for i in range(1, len(n) + 1):
            if (up := i + (i & -i)) <= len(n):
                self.sums[up] += self.sums[i]

    def range(self, s: int) -> tuple[int, int, int]:
        if not self.n[s]:
            raise ValueError(f"symbol {s} has the count 0")
        low, i = 0, s
        while i:
            low += self.sums[i]
            i &= i - 1
        return low, low + self.n[s], self.all

    def find(self, target: int) -> int:
        at, step = 0, 1 << len(self.n).bit_length() - 1
        while step:
            if at + step <= len(self.n) and self.sums[at + step] <= target:
                at += step
                target -= self.sums[at]
            step >>= 1
        return at

    def see(self, s: int) -> None:
        if not self.step:
            return
        self.n[s] += self.step
        self.all += self.step
        i = s + 1
        while i <= len(self.n):
            self.sums[i] += self.step
            i += i & -i
        if self.all > 1 << 16:
            self.set([(x + 1) // 2 for x in self.n])


def encode_symbols(symbols: Iterable[int], model: Model) -> bytes:
    """Arithmetic code (Witten, Neal and Cleary 1987) of symbols by a model, which is changed if it is adaptive."""
    bits, low, high, waiting = [], 0, _TOP, 0

    def put(bit: int) -> None:
        nonlocal waiting
        bits.append(bit)
        bits.extend([1 - bit] * waiting)
        waiting = 0

    for s in symbols:
        a, b, n = model.range(s)
        span = high - low + 1
        low, high = low + span * a // n, low + span * b // n - 1
        while True:
            if high < _HALF:
                put(0)
            elif low >= _HALF:
                put(1)
                low, high = low - _HALF, high - _HALF
            elif low >= _QUARTER and high < 3 * _QUARTER:
                waiting += 1
                low, high = low - _QUARTER, high - _QUARTER
            else:
                break
            low, high = 2 * low, 2 * high + 1
        model.see(s)
    waiting += 1
    put(0 if low < _QUARTER else 1)
    return np.packbits(np.array(bits, np.uint8)).tobytes()


def decode_symbols(data: bytes, model: Model) -> Iterator[int]:
    """The symbols of encode_symbols() and, as no end is coded, others without end after them."""
    bits = iter([*np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), *[0] * 64])
    low, high, value = 0, _TOP, 0
    for _ in range(32):
        value = 2 * value + next(bits)
    while True:
        span, n = high - low + 1, model.all
        s = model.find(((value - low + 1) * n - 1) // span)
        yield s
        a, b, n = model.range(s)
        low, high = low + span * a // n, low + span * b // n - 1
        while True:
            if high < _HALF:
                pass
            elif low >= _HALF:
                low, high, value = low - _HALF, high - _HALF, value - _HALF
            elif low >= _QUARTER and high < 3 * _QUARTER:
                low, high, value = low - _QUARTER, high - _QUARTER, value - _QUARTER
            else:
                break
            low, high, value = 2 * low, 2 * high + 1, 2 * value + next(bits, 0)
        model.see(s)


END = 256  # after the last byte


def _bytes_and_end() -> Model:
    return Model([1] * 257, 32)


def arithmetic_encode(data: bytes) -> bytes:
    """Adaptive arithmetic code of bytes with an end symbol."""
    return encode_symbols([*data, END], _bytes_and_end())


def arithmetic_decode(data: bytes) -> bytes:
    return bytes(takewhile(lambda s: s != END, decode_symbols(data, _bytes_and_end())))


FRAME = 65_536  # bytes of a frame


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def framed_encode(data: bytes, size: int = FRAME) -> bytes:
    """Arithmetic code in frames: bytes before and after as varints, then the code. Frames are coded apart."""
    out = bytearray()
    for at in range(0, len(data), size):
        coded = arithmetic_encode(data[at : at + size])
        out += _varint(min(size, len(data) - at)) + _varint(len(coded)) + coded
    return bytes(out)


def framed_decode(data: bytes, budget: int | None = None) -> bytes:
    """What the frames hold; with a budget, of those frames that lie within so many bytes."""
    out, at = bytearray(), 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            n |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return n

    while at < len(data):
        raw, coded = varint(), varint()
        if budget is not None and at + coded > budget:
            break
        part = arithmetic_decode(data[at : at + coded])
        if len(part) != raw:
            raise ValueError(f"a frame holds {len(part)} bytes and not {raw}")
        out += part
        at += coded
    return bytes(out)


ENCODERS = {"rle": bytes, "huffman": huffman_encode, "arithmetic": framed_encode}


def _coder(encoding: str):
    if encoding not in ENCODERS:
        raise ValueError(f"no encoder for {encoding}")
    return ENCODERS[encoding]


def encode_block(q: np.ndarray, level: int, top: int, passes: int = 0) -> tuple[bytes, int, list[tuple[int, int]]]:
    """A block's runs, its bytes before them, and the bits of its passes; top is the threshold of the whole matrix."""
    ezw, sizes = ezw_encode(q, level, passes, top)
    return rle_encode(ezw), len(ezw), sizes


def finish(blocks: list[bytes], encoding: str = "huffman") -> tuple[bytes, int]:
    """The payload of some blocks' runs, merged without decompressing them, and the bytes of the merged runs."""
    rle = rle_merge(blocks)
    return _coder(encoding)(rle), len(rle)


def encode_payload(q: np.ndarray, level: int, passes: int = 0, encoding: str = "huffman") -> tuple[bytes, dict]:
    """Zerotree, runs, entropy code of one block; with the sizes after each and the bits of each pass."""
    _coder(encoding)
    rle, ezw_size, sizes = encode_block(q, level, int(leading_bits(np.abs(q.ravel()).astype(np.int64)).max(initial=0)), passes)
    out, rle_size = finish([rle], encoding)
    return out, {"passes": len(sizes), "ezw_size": ezw_size, "rle_size": rle_size, "enc_size": len(out), "bits": sizes}


def decode_payload(data: bytes, rows: int, cols: int, level: int, top: int, passes: int, rle_size: int, encoding: str = "huffman", blocks: int = 1, limit: int = 0) -> list[np.ndarray]:
    """The blocks of a payload. passes is what it was coded with (0: all); limit, below it, stops early."""
    _coder(encoding)
    rle = {"rle": bytes, "huffman": lambda x: huffman_decode(x, rle_size), "arithmetic": framed_decode}[encoding](data)
    ezw, out = rle_decode(rle), []
    for _ in range(blocks):
        block, used = ezw_decode(ezw, rows // blocks, cols, level, top, passes)
        ezw = ezw[used:]
        if limit and top >> (limit - 1):
            step = max(top >> limit, 1)
            size = np.abs(block)
            block = np.where(size < top >> (limit - 1), 0, np.sign(block) * (size - size % step))
        out.append(block)
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
