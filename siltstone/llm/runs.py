"""Equal keys across a corpus without gathering a hot key's rows in one task.

A map task groups the keys of a batch first. Where ``HOT`` rows or more share one
key, the first is its lead and goes on under the key; the others are members that
already know their lead and only pass through. A key therefore brings a few rows
a batch to a task, whatever share of the corpus has it.

Rows travel packed: sorted, as differences, byte by byte of significance, and
compressed, one blob for each batch and part. A part is a range of keys, and there
are as many parts as keep one at ``PART_ROWS`` rows, about.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of one key in a batch from which they are led.
HOT = 3
PART_ROWS = 500_000

SCHEMA = "part long, data binary"
#: What a run hands on; the lead is the run's first row, or the batch's for its members.
RUN_SCHEMA = "key long, id long, place long, lead_id long, lead_place long, until long"


def pack(x: np.ndarray) -> bytes:
    """Bytes of integers by significance, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()) if len(x) else b""


def unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of equal width over all 64-bit keys (parts below 2^32)."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def parts_for(rows: float) -> int:
    return max(1, math.ceil(rows / PART_ROWS))


def _blob(columns: list[np.ndarray]) -> bytes:
    packed = [pack(c) for c in columns]
    return np.array([len(p) for p in packed], np.int64).tobytes() + b"".join(packed)


def _columns(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob[: 8 * len(kinds)], np.int64), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(unpack(blob[at : at + n], kind))
        at += n
    return out


_SENT = [np.uint64, np.uint32, np.int64, np.int64, np.uint8]
_LED = [np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64]


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def led(key: np.ndarray, check: np.ndarray, ident: np.ndarray, place: np.ndarray, parts: int, stretch: bool = False) -> pa.RecordBatch:
    """One batch's rows as blobs. key and check are uint64 hashes of one content, ident and place int64.

    With ``stretch`` members at consecutive places of one id become one row, up to ``until``.
    """
    order = np.lexsort((place, ident, check, key))
    key, check, ident, place = key[order], check[order], ident[order], place[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(key)))
    first, many = np.repeat(start, size), np.repeat(size, size) >= HOT
    sent = fresh | ~many
    where, data = [], []
    cols = [key[sent], (check[sent] >> np.uint64(32)).astype(np.uint32), ident[sent], place[sent], (many & fresh)[sent].astype(np.uint8)]
    part = part_of(cols[0], parts)
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            where.append(int(part[a]))
            data.append(b"K" + _blob([_delta(cols[0][a:b]), *(c[a:b] for c in cols[1:])]))
    rest = ~sent
    if rest.any():
        k, i, p, li, lp = key[rest], ident[rest], place[rest], ident[first][rest], place[first][rest]
        until = p
        if stretch:
            order = np.lexsort((p, i))
            k, i, p, li, lp = k[order], i[order], p[order], li[order], lp[order]
            cut = np.flatnonzero((np.diff(i) != 0) | (np.diff(p) != 1)) + 1
            a, b = np.concatenate([[0], cut]), np.append(cut, len(p)) - 1
            k, i, p, li, lp, until = k[a], i[a], p[a], li[a], lp[a], p[b]
        # members only pass through: any part will do, and one batch's go together
        where.append(int(part_of(key[:1] * np.uint64(0x9E3779B97F4A7C15), parts)[0]))
        data.append(b"M" + _blob([k, i, p, li, lp, until]))
    return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])


def shared(blobs: DataFrame) -> DataFrame:
    """The rows whose content another row has (RUN_SCHEMA). One shuffle.

    The lead is the run's first row by (id, place); a member keeps its batch's
    lead, which is itself a row of the run. Rows that repeat an (id, place) count
    once: they do not make a run by themselves.
    """

    def run(t: pa.Table) -> pa.Table:
        sent, out = [], []
        for x in t.column("data"):
            data = x.as_py()
            if data[:1] == b"M":
                out.append([c.view(np.int64) for c in _columns(data[1:], _LED)])
            else:
                cols = _columns(data[1:], _SENT)
                cols[0] = np.cumsum(cols[0], dtype=np.uint64)
                sent.append(cols)
        if sent:
            key, check, ident, place, lead = (np.concatenate(c) for c in zip(*sent, strict=True))
            del sent
            order = np.lexsort((place, ident, check, key))
            key, check, ident, place, lead = key[order], check[order], ident[order], place[order], lead[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
            start = np.flatnonzero(fresh)
            size = np.diff(np.append(start, len(key)))
            first = np.repeat(start, size)
            others = np.add.reduceat(((ident != ident[first]) | (place != place[first])).astype(np.int64), start)
            live = (np.repeat(others, size) > 0) | (lead > 0)
            first = first[live]
            out.append([key[live].view(np.int64), ident[live], place[live], ident[first], place[first], place[live]])
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        return pa.table({n.split()[0]: pa.array(c) for n, c in zip(RUN_SCHEMA.split(", "), cols, strict=True)})

    return blobs.groupBy("part").applyInArrow(run, RUN_SCHEMA)
