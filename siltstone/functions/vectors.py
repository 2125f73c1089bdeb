"""Vector expressions over arrays of floats; sums are in double, in component order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column | str, b: Column | str) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def chunk_offsets(dims: int, chunks: int) -> list[int]:
    """Ends of the chunks' components; no chunks means one a component."""
    n = chunks or dims
    return [c * dims // n for c in range(n + 1)]


def chunks(v: Column | str, dims: int, n: int) -> Column:
    """The vector's chunks, as an array of arrays."""
    at = chunk_offsets(dims, n)
    return F.array(*[F.slice(v, a + 1, b - a) for a, b in zip(at, at[1:], strict=False)])
