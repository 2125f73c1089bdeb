"""Hashes and generators that results depend on bit by bit.

FNV-1a of 32 bits is a fold of built-in functions; what needs arithmetic modulo
2^64 runs in numpy over Arrow batches. 64-bit results are the signed reading of
the unsigned value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: FNV-1a offsets and primes, the CRC-32C polynomial (reflected), and splitmix64's increment and multipliers; fixed values.
FNV32 = (2166136261, 16777619)
FNV64 = (14695981039346656037, 1099511628211)
CRC32C = 0x82F63B78
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def fnv1a32(key: Column) -> Column:
    """Unsigned, as a long. The key's bytes are read from its hexadecimal form."""
    offset, prime = FNV32
    h = F.hex(key.cast("binary"))
    bytes_ = F.transform(F.sequence(F.lit(0), (F.greatest(F.length(h), F.lit(2)) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(h, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    fold = F.aggregate(bytes_, F.lit(offset).cast("long"), lambda s, b: (s.bitwiseXOR(b) * F.lit(prime)) % F.lit(1 << 32))
    return F.when(F.length(h) == 0, F.lit(offset).cast("long")).otherwise(fold)


def splitmix64(x: np.ndarray) -> np.ndarray:
    a, b, c = map(np.uint64, SPLITMIX)
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + a
        x = (x ^ (x >> np.uint64(30))) * b
        x = (x ^ (x >> np.uint64(27))) * c
    return x ^ (x >> np.uint64(31))


def _columns(data: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The j-th bytes of many values at once: (j, which values, their bytes). Values go by length, longest first."""
    sizes = np.array([len(d) for d in data], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(data[i] for i in order), np.uint8)
    starts = np.cumsum(sizes[order]) - sizes[order]
    n = len(data)
    for j in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes[order], -j, "left"))  # values of more than j bytes
        yield j, order[:n], flat[starts[:n] + j]


def fnv1a64_all(data: list[bytes]) -> np.ndarray:
    """FNV-1a of 64 bits of many values, byte by byte across all of them."""
    h, prime = np.full(len(data), FNV64[0], np.uint64), np.uint64(FNV64[1])
    for _, own, byte in _columns(data):
        h[own] = (h[own] ^ byte) * prime
    return h


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C), table >> 1)
    return table


def crc32c_all(data: list[bytes]) -> np.ndarray:
    """CRC-32C of many values, byte by byte across all of them."""
    table, c = _crc_table(), np.full(len(data), 0xFFFFFFFF, np.uint32)
    for _, own, byte in _columns(data):
        c[own] = table[(c[own] ^ byte) & 0xFF] ^ (c[own] >> 8)
    return c ^ np.uint32(0xFFFFFFFF)


def fnv1a64_of(data: bytes) -> int:
    return int(fnv1a64_all([data])[0])


def crc32c_of(data: bytes) -> int:
    return int(crc32c_all([data])[0])


def _raw(x: str | bytes) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _known(values: pd.Series, of: Callable[[list[bytes]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which values are not null, and their hashes; a value that repeats is hashed once."""
    there = values.notna().to_numpy()
    codes, distinct = pd.factorize(pd.Series([_raw(v) for v in values[there]], dtype=object))
    return there, of(list(distinct))[codes] if len(distinct) else np.zeros(0, np.uint64)


@F.pandas_udf(LongType())
def fnv1a64(key: pd.Series) -> pd.Series:
    """Signed reading of FNV-1a of 64 bits."""
    there, h = _known(key, fnv1a64_all)
    out = pd.array([None] * len(key), dtype="Int64")
    out[there] = h.view(np.int64)
    return pd.Series(out)


@F.pandas_udf(StringType())
def crc32c(value: pd.Series) -> pd.Series:
    """CRC-32C as 8 hexadecimal digits."""
    there, h = _known(value, crc32c_all)
    out = np.full(len(value), None, object)
    out[there] = [f"{c:08x}" for c in h]
    return pd.Series(out)


def unsigned_mod(h: Column, n: int) -> Column:
    """A signed 64-bit hash, read as unsigned, modulo n."""
    return F.pmod(F.pmod(h, F.lit(n)) + F.when(h < 0, (1 << 64) % n).otherwise(0), F.lit(n))


def first_bytes_mod(key: Column, n: int) -> Column:
    """The first four bytes of a key, or as many as it has, as a little-endian number modulo n."""
    h = F.hex(F.substring(key.cast("binary"), 1, 4))
    le = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.coalesce(F.conv(le, 16, 10).cast("long"), F.lit(0)) % n
