"""A stated set of queries against all rows, in cells of a block of queries and a part of the rows.

A cell is one task: it holds its queries and the best rows so far, and streams its
part of the rows, so that memory follows the block. A few rows a query leave a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries in a block, entries of the matrix of a block and the rows that it meets at once, cells for each core.
BLOCK, TILE, CELLS = 16384, 1 << 21, 2


class Best:
    """The k least (dist, id) so far of each query; what came in meanwhile waits until it is worth sorting."""

    def __init__(self, n: int, k: int):
        self.k, self.far = k, np.full(n, np.inf)
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        self.fresh: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, row: np.ndarray, ident: np.ndarray, dist: np.ndarray) -> None:
        self.fresh.append([row, ident, dist])
        self.waiting += len(row)
        if self.waiting * 2 >= len(self.far) * self.k or np.isinf(self.far).any():
            self.merge()

    def merge(self) -> None:
        row, ident, dist = (np.concatenate(x) for x in zip(self.held, *self.fresh, strict=True))
        order = np.lexsort((ident, dist))
        order = order[np.argsort(row[order].astype(np.uint16) if len(self.far) <= 1 << 16 else row[order], kind="stable")]
        row, ident, dist = row[order], ident[order], dist[order]
        own = self.kept(row, dist)
        self.held, self.fresh, self.waiting = [row[own], ident[own], dist[own]], [], 0

    def kept(self, row: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Which of the sorted rows stay; sets the distance beyond which no row is needed."""
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        last = nth == self.k - 1
        self.far[row[last]] = dist[last]
        return nth < self.k


def places(held: np.ndarray) -> np.ndarray:
    """Flat places of the few true entries of a contiguous matrix: words of eight first, then their bytes."""
    flat = held.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    at = np.flatnonzero(flat.reshape(-1, 8)[words])
    return words[at >> 3] * 8 + (at & 7)


def regular(n: int) -> F.Column:
    """Whether (id, v) has an id and n components that are numbers whose squares a double holds."""
    return F.coalesce(F.col("id").isNotNull() & (F.size("v") == n) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < 1e140)), F.lit(False))


def layout(n: int, cores: int) -> tuple[int, int]:
    """Blocks of n queries and parts of the rows; a row is sent once to each block."""
    blocks = max(1, -(-n // BLOCK))
    parts = max(1, -(-cores * CELLS // blocks))
    return max(blocks, -(-blocks * parts // cores) * cores // parts), parts  # so that no core waits for another's last cell


def cells(base: DataFrame, queries: DataFrame, n: int, make: Callable[[np.ndarray, np.ndarray], object]) -> DataFrame:
    """(qid, id, dist) of the n queries (id, v) against all rows (id, v), long and array<double or float>, without nulls.

    ``make(qids, q)`` gives an object with ``add(ids, x)`` for rows and ``rows()`` for (qid, id, dist).
    """
    blocks, parts = layout(n, base.sparkSession.sparkContext.defaultParallelism)
    block, part = (F.pmod(F.xxhash64("id"), F.lit(m)).cast("int") for m in (blocks, parts))
    to = lambda at, upto, by: F.explode(F.sequence(at, at + F.lit(upto), F.lit(by))).alias("cell")
    sent = queries.select(F.lit(0).alias("role"), "id", "v", to(block * parts, parts - 1, 1))
    sent = sent.unionByName(base.select(F.lit(1).alias("role"), "id", "v", to(part, (blocks - 1) * parts, parts)))
    sent = sent.repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", "role").select("cell", "role", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, best = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], names=["qid", "id", "dist"])

        for batch in batches:
            cell, role, ident = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)], strict=True):
                if a == b:
                    continue
                x = batch.column(3).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
                if cell[a] != at:
                    yield from done()
                    at, asked, best = cell[a], [], None
                if role[a] == 0:
                    asked.append((ident[a:b], x))
                elif asked:
                    best = best or make(*(np.concatenate(y) for y in zip(*asked, strict=True)))
                    best.add(ident[a:b], x)
        yield from done()

    return sent.mapInArrow(run, "qid long, id long, dist double")
