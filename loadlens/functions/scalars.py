"""Scalar functions over columns."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str | int) -> Column:
    return F.lit(c).cast("long") if isinstance(c, int) else F.col(c) if isinstance(c, str) else c


def is_power_of_2(n) -> Column:
    """True for powers of two, and for 0."""
    n = _col(n)
    return n.bitwiseAND(n - 1) == 0


def log2_pow2(n) -> Column:
    """Exponent of the leading bit; -1 for 0."""
    n = _col(n)
    return F.when(n <= 0, F.lit(-1)).otherwise(F.length(F.bin(n)) - 1)


def _shift(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def le_power_of_2(n) -> Column:
    """The largest power of two not above n; 0 for 0."""
    n = _col(n)
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(_shift(F.length(F.bin(F.greatest(n, F.lit(1)))) - 1))


def ge_power_of_2(n) -> Column:
    """The least power of two not below n; 1 for 0 and 1."""
    n = _col(n)
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(_shift(F.length(F.bin(F.greatest(n - 1, F.lit(1))))))


def divisible_by_2(n, level: int) -> Column:
    return _col(n) % (1 << level) == 0


def bits_to_bytes(bits) -> Column:
    return F.floor((_col(bits) + 7) / 8).cast("long")


def manhattan(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def varint_hex(n) -> Column:
    """Groups of seven bits, low first, the high bit set on all but the last, as hex."""
    n = _col(n)
    groups = F.greatest(F.ceil(F.length(F.bin(n)) / 7.0).cast("int"), F.lit(1))
    byte = lambda i: F.call_function("shiftright", n, (7 * i).cast("int")).bitwiseAND(F.lit(127)) + F.when(i < groups - 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")


def from_varint_hex(h) -> Column:
    h = _col(h)
    part = lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), F.lit(0).cast("long"), lambda s, i: s + F.call_function("shiftleft", part(i).bitwiseAND(F.lit(127)), (7 * i).cast("int")))


def fixed_hex(n, size: int) -> Column:
    """Little-endian fixed width, as hex."""
    n = _col(n)
    return F.concat(*[F.lpad(F.hex(F.call_function("shiftright", n, F.lit(8 * i)).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)])


def bits_text(n, width: int = 8) -> Column:
    return F.lpad(F.bin(_col(n)), width, "0")


def insert_bits(dest, src, count, offset) -> Column:
    """Bit text dest with count bits of src written from offset on."""
    dest, src, count, offset = map(_col, (dest, src, count, offset))
    return F.concat(F.substr(dest, F.lit(1), offset), F.substr(src, F.lit(1), count), F.substr(dest, offset + count + 1))


def radix_parent(rank) -> Column:
    """Parent in the radix tree over ranks from 0; -1 for the root."""
    r = _col(rank) + 1
    top = F.length(F.bin(r)) - 1
    return F.when(r <= 1, F.lit(-1).cast("long")).otherwise(_shift(top - 1).bitwiseOR(r.bitwiseAND(_shift(F.greatest(top - 1, F.lit(0))) - 1)) - 1)


def radix_child(rank, child: int, size: int) -> Column:
    r = _col(rank) + 1
    top = F.length(F.bin(r)) - 1
    found = _shift(top + 1).bitwiseOR(F.call_function("shiftleft", F.lit(child).cast("long"), top)).bitwiseOR(r.bitwiseAND(_shift(top) - 1)) - 1
    return F.when(found >= size, F.lit(-1).cast("long")).otherwise(found)


def radix_preorder(size: int) -> list[int]:
    """Ranks of the radix tree, each before its children and the left child's before the right one's."""
    out, todo = [], [0]
    while todo:
        rank = todo.pop()
        out.append(rank)
        top = (rank + 1).bit_length() - 1
        own = (rank + 1) - (1 << top)
        todo += [c for c in ((1 << (top + 1) | side << top | own) - 1 for side in (1, 0)) if c < size]
    return out


def search_tree(size: int) -> list[tuple[int, int, int, int]]:
    """(rank, parent, left, right) of the balanced search tree over ranks; a table as long as there are ranks."""
    out, todo = [], [(0, size - 1, -1)]
    middle = lambda low, high: low + (high - low) // 2 if low <= high else -1
    while todo:
        low, high, parent = todo.pop()
        if low > high:
            continue
        at = middle(low, high)
        out.append((at, parent, middle(low, at - 1), middle(at + 1, high)))
        todo += [(low, at - 1, at), (at + 1, high, at)]
    return sorted(out)


def normal_quantile(p: float) -> float:
    """Inverse normal distribution; 0 outside (0, 1)."""
    return NormalDist().inv_cdf(p) if 0 < p < 1 else 0.0


def confidence_z(confidence: float) -> float:
    """Two-sided standard score of a confidence."""
    return normal_quantile((confidence + 1) / 2)


#: Coefficients of Acklam's rational approximation to the normal quantile.
_NUM_MID = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_DEN_MID = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_NUM_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_DEN_TAIL = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(coefficients: tuple, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile_column(p) -> Column:
    """Acklam's approximation as a column expression (relative error 1.15e-9)."""
    p = _col(p)
    low = 0.02425
    tail = lambda q: _poly(_NUM_TAIL, q) / _poly(_DEN_TAIL, q)
    mid = p - 0.5
    return (
        F.when((p <= 0) | (p >= 1), 0.0)
        .when(p < low, tail(F.sqrt(-2 * F.ln(p))))
        .when(p <= 1 - low, mid * _poly(_NUM_MID, mid * mid) / _poly(_DEN_MID, mid * mid))
        .otherwise(-tail(F.sqrt(-2 * F.ln(1 - p))))
    )


def sample_size(total, squares, n, confidence: float, error: float, normalize: bool = True, floor: float | None = 1e-9) -> Column:
    """Least sample of n values that estimates their mean within the error.

    With normalize the error is relative to the mean; floor bounds the
    deviation from below, None leaves it.
    """
    total, squares, n = map(_col, (total, squares, n))
    mean = total / n
    deviation = F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))
    if floor is not None:
        deviation = F.greatest(deviation, F.lit(floor))
    reach = F.lit(error) * (mean if normalize else F.lit(1.0))
    v = F.try_divide(reach, F.lit(confidence_z(confidence)) * deviation)
    return F.round(n / (1 + n * v * v)).cast("long")


def split_any(text, delimiters: str) -> Column:
    """Parts between any of the delimiter characters, without empty ones."""
    pattern = "[" + "".join("\\" + c for c in delimiters) + "]"
    return F.filter(F.split(_col(text), pattern), lambda x: x != "")


def split_str(text, delimiter: str) -> Column:
    return F.filter(F.split(_col(text), "\\Q" + delimiter + "\\E"), lambda x: x != "")


def trim_chars(text, chars: str) -> Column:
    return F.btrim(_col(text), F.lit(chars))


def invert_permutation(p) -> Column:
    """Where each number 0..n-1 stands in an array that permutes them."""
    p = _col(p)
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (F.array_position(p, i) - 1).cast("int"))


ENCODINGS = ("none", "rle", "huffman", "arithmetic")


def encoding_code(name) -> Column:
    """Number of an encoding by its name in any case; null for others."""
    out = F.lit(None).cast("int")
    for i, e in enumerate(ENCODINGS):
        out = F.when(F.lower(_col(name)) == e, i).otherwise(out)
    return out
