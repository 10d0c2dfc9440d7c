"""The legacy binary formats of keys, call paths and headers, in Arrow batches."""

from __future__ import annotations

import struct
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F


def put_varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = bytes(data), 0

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        out, shift = 0, 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    def text(self) -> str:
        return self.take(self.varint()).decode()


def put_path(path: list[tuple[str, int]] | None) -> bytes:
    """Distinct modules with ids and names, then the frames; a null path has none of either."""
    path = path or []
    ids = {m: i for i, m in enumerate(dict.fromkeys(m for m, _ in path))}
    out = put_varint(len(ids))
    for m, i in ids.items():
        raw = m.encode()
        out += put_varint(i) + put_varint(len(raw)) + raw
    return out + put_varint(len(path)) + b"".join(put_varint(ids[m]) + put_varint(o) for m, o in path)


def get_path(r: Reader) -> list[tuple[str, int]] | None:
    names = {}
    for _ in range(r.varint()):
        i = r.varint()
        names[i] = r.text()
    return [(names[r.varint()], r.varint()) for _ in range(r.varint())] or None


def put_key(metric: str, kind: int, start, end) -> bytes:
    raw = metric.encode()
    return put_varint(len(raw)) + raw + struct.pack("<i", kind) + put_path(start) + put_path(end)


def get_key(r: Reader) -> tuple:
    metric = r.text()
    kind = struct.unpack("<i", r.take(4))[0]
    return metric, kind, get_path(r), get_path(r)


HEADER = ("rows", "cols", "level", "mean", "scale", "threshold", "encoding", "blocks", "passes", "ezw_size", "rle_size", "enc_size")


def put_header(h: dict) -> bytes:
    """Varints but for the 8-byte mean, the threshold's exponent (-1 for 0) and the encoding, a byte each."""
    exponent = h["threshold"].bit_length() - 1
    out = b"".join(put_varint(h[k]) for k in HEADER[:3]) + struct.pack("<q", h["mean"]) + put_varint(h["scale"])
    return out + struct.pack("<bb", exponent, h["encoding"]) + b"".join(put_varint(h[k]) for k in HEADER[7:])


def get_header(r: Reader) -> dict:
    h = {k: r.varint() for k in HEADER[:3]}
    h["mean"] = struct.unpack("<q", r.take(8))[0]
    h["scale"] = r.varint()
    exponent, h["encoding"] = struct.unpack("<bb", r.take(2))
    h["threshold"] = 1 << exponent if exponent >= 0 else 0
    return {k: h[k] for k in HEADER[:7]} | {k: r.varint() for k in HEADER[7:]}


def path_bytes(path: Column) -> Column:
    @F.pandas_udf("binary")
    def run(paths: pd.Series) -> pd.Series:
        return pd.Series([put_path(None if p is None else [(f["module"], f["off"]) for f in p]) for p in paths])

    return run(path)


def path_from_bytes(data: Column) -> Column:
    @F.pandas_udf("array<struct<module string, off long>>")
    def run(rows: pd.Series) -> pd.Series:
        found = (get_path(Reader(x)) for x in rows)
        return pd.Series([None if p is None else [{"module": m, "off": o} for m, o in p] for p in found])

    return run(data)


PATH_TYPE = "array<struct<module string, off long>>"


def key_bytes(metric: Column, kind: Column, start: Column, end: Column) -> Column:
    """A key's bytes; a null path is one without frames."""

    def frames(p):
        return None if p is None else [(f["module"], f["off"]) for f in p]

    @F.pandas_udf("binary")
    def run(metrics: pd.Series, kinds: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([put_key(m, int(k), frames(a), frames(b)) for m, k, a, b in zip(metrics, kinds, starts, ends)])

    return run(metric, kind, start, end)


def key_from_bytes(data: Column) -> Column:
    """Struct (metric, kind, start, end) of a key's bytes."""

    def frames(p):
        return None if p is None else [{"module": m, "off": o} for m, o in p]

    @F.pandas_udf(f"struct<metric string, kind int, start {PATH_TYPE}, end {PATH_TYPE}>")
    def run(rows: pd.Series) -> pd.DataFrame:
        keys = [get_key(Reader(x)) for x in rows]
        return pd.DataFrame([(m, k, frames(a), frames(b)) for m, k, a, b in keys], columns=["metric", "kind", "start", "end"])

    return run(data)


def header_bytes(header: Column) -> Column:
    """The bytes of a struct of HEADER's fields."""

    @F.pandas_udf("binary")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([put_header(h) for h in rows.to_dict("records")])

    return run(header)


def header_from_bytes(data: Column) -> Column:
    """Struct of HEADER's fields, all long."""

    @F.pandas_udf(f"struct<{', '.join(f'{h} long' for h in HEADER)}>")
    def run(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([get_header(Reader(x)) for x in rows], columns=list(HEADER))

    return run(data)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
