"""Exact top-k inner products by pivot-table elimination.

The table holds every vector's distances to the pivots; it is made once, when the
rows are packed, and travels with them. For a query q and a vector x the triangle
inequality gives |q - x| >= max_p |d(q, p) - d(x, p)|, and with it
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 has an upper bound. Rows are packed by their
nearest pivot in runs of ``RUN``, whose ranges of distances bound them as a whole.
For ``ASKED`` queries at once, runs are evaluated in bound order, ``STEP`` at a time,
until the next bounds are below all k-th scores held; of a step's rows only those
whose own bound reaches the k-th score of some query are multiplied.

Queries are packed in blocks of ``QUERY_BLOCK`` and the rows in blocks of
``ROW_BLOCK``; a row block is sent once for each query block, and a task streams row
blocks past one query block, so that its memory is that of two blocks whatever the
table. The work is that of a stated query set against all rows: the bounds cut
products, not the pairs of blocks.

Scores are integers throughout: products of doubles where they stay below 2^53, of
64-bit integers below 2^63, of Python's integers beyond; a score that a long cannot
hold is given as the nearest long.

Defined results: vectors that are null or that hold a null or a non-finite component
take no part; vectors meet those of their own length only. A row never answers for
its own id; a row without an id takes no part; repeated ids count once each; ties go
to the smaller id; fewer than k rows give all of them; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches, materialize, shuffle_parts, table

QUERY_BLOCK, ROW_BLOCK = 8192, 4096
#: Queries that are served at once, rows of a run, and runs of a step.
ASKED, RUN, STEP = 512, 128, 8
#: Pivots are picked far apart among this many vectors of smallest hashed id.
PIVOTS, PIVOT_SAMPLE = 16, 2000
_LONG = 2**63 - 1
#: Below every score.
_NONE = -(2**63)


def pick_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    if not len(x):
        return x
    own = [int(np.argmax((x * x).sum(1)))]
    far = ((x - x[own[0]]) ** 2).sum(1)
    while len(own) < min(n, len(x)) and far.max() > 0:
        own.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[own[-1]]) ** 2).sum(1))
    return x[own]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(sq, 0))


class Block:
    """Packed rows: ids, vectors, distances to the pivots."""

    def __init__(self, ids: bytes, vectors: bytes, kind: str, dim: int, near: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, kind).reshape(len(self.ids), dim).astype(np.float64)
        self.d = np.frombuffer(near, np.float32).reshape(len(self.ids), -1)
        self.sq = (self.x * self.x).sum(1)
        self.most = float(np.abs(self.x).max(initial=0))

    def __len__(self) -> int:
        return len(self.ids)


def products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products, as longs, of integers held as doubles; ``most`` is the product of the largest of each."""
    if x.shape[1] * most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if x.shape[1] * most < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q) @ whole(x).T, -_LONG, _LONG).astype(np.int64)


class Held:
    """The best k of a block of queries so far: scores descending, then ids ascending."""

    def __init__(self, asked: Block, k: int):
        self.asked, self.k = asked, k
        self.size = np.zeros(len(asked), np.int64)
        self.score, self.who = np.full((len(asked), k), _NONE), np.zeros((len(asked), k), np.int64)

    def offer(self, rows: Block) -> None:
        starts = np.arange(0, len(rows), RUN)
        ends = np.append(starts[1:], len(rows))
        least, most, largest = np.minimum.reduceat(rows.d, starts), np.maximum.reduceat(rows.d, starts), np.maximum.reduceat(rows.sq, starts)
        length = np.sqrt(rows.sq.max(initial=0)) + np.sqrt(self.asked.sq.max(initial=0))
        # rounding of distances and of single precision is less than this; no candidate may be lost to it
        slack = 1e-5 * (1 + float(self.asked.d.max(initial=0)) + float(rows.d.max(initial=0))) + 1e-6 * length
        for begin in range(0, len(self.asked), ASKED):
            at = slice(begin, min(begin + ASKED, len(self.asked)))
            d, sq = self.asked.d[at], self.asked.sq[at]
            apart = np.zeros((len(d), len(starts)), np.float32)
            for p in range(d.shape[1]):
                np.maximum(apart, np.maximum(least[:, p] - d[:, p, None], d[:, p, None] - most[:, p]), out=apart)
            reach = self._bound(sq, largest, apart, slack)
            todo = np.argsort(-reach.max(0), kind="stable")
            while len(todo):
                todo = todo[(reach[:, todo] >= self.score[at, -1, None]).any(0)]
                step, todo = np.sort(todo[:STEP]), todo[STEP:]
                if len(step):
                    self._step(at, rows, np.concatenate([np.arange(starts[r], ends[r]) for r in step]), slack)

    def _step(self, at: slice, rows: Block, own: np.ndarray, slack: float) -> None:
        d, near, floor = self.asked.d[at], rows.d[own].T.copy(), self.score[at, -1]
        low, gap = np.zeros((len(d), len(own)), np.float32), np.empty((len(d), len(own)), np.float32)
        for p in range(d.shape[1]):
            np.subtract(d[:, p, None], near[p], out=gap)
            np.maximum(low, np.abs(gap, out=gap), out=low)
        own = own[(self._bound(self.asked.sq[at], rows.sq[own], low, slack) >= floor[:, None]).any(0)]
        score = products(self.asked.x[at], rows.x[own], self.asked.most * rows.most)
        score[self.asked.ids[at, None] == rows.ids[own]] = _NONE
        if score.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(score, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((score >= floor[:, None]) & (score > _NONE))
        cut = np.flatnonzero(np.diff(i)) + 1
        for a, b in zip([0, *cut], [*cut, len(i)], strict=True):
            if b > a:
                self._take(at.start + i[a], rows.ids[own[j[a:b]]], score[i[a], j[a:b]])

    @staticmethod
    def _bound(sq: np.ndarray, other: np.ndarray, apart: np.ndarray, slack: float) -> np.ndarray:
        """Upper bounds of scores; what cannot be told in doubles has none."""
        with np.errstate(over="ignore", invalid="ignore"):
            low = np.maximum(apart.astype(np.float64) - slack, 0)
            low *= -low / 2
            low += (sq * (0.5 + 1e-6) + 1e-6)[:, None]
            low += other * (0.5 + 1e-6)
        low[~np.isfinite(low)] = np.inf
        return low

    def _take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        n = self.size[i]
        score, who = np.concatenate([self.score[i, :n], scores]), np.concatenate([self.who[i, :n], ids])
        best = np.lexsort((who, -score))[: self.k]
        self.size[i] = len(best)
        self.score[i, : len(best)], self.who[i, : len(best)] = score[best], who[best]


PACKED = "ids binary, vectors binary, kind string, dim int, near binary"


def _blocks(df: DataFrame, vec: str, emb: str, size: int, pivots: Broadcast | None = None) -> DataFrame:
    """Rows packed by up to ``size``, by nearest pivot; components floor(64 x) in the narrowest kind that holds them."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        kept: dict[int, list] = {}
        for i, row in zip(ids, rows, strict=True):
            if row is None or None in row:
                continue
            v = np.asarray(row, np.float64)
            if np.isfinite(v).all():
                # 64 times a double near the largest is none; it is held at 1e308, and its scores at a long's end
                kept.setdefault(len(v), []).append((i, np.clip(np.floor(64 * v), -1e308, 1e308)))
        out = []
        for dim, own in kept.items():
            ident, x = np.array([i for i, _ in own], np.int64), np.array([v for _, v in own]).reshape(len(own), dim)
            near = np.zeros((len(own), 0), np.float32)
            if pivots is not None and dim in pivots.value:
                near = to_pivots(x, pivots.value[dim]).astype(np.float32)
                order = np.lexsort((near.min(1), near.argmin(1)))
                ident, x, near = ident[order], x[order], near[order]
            most = np.abs(x).max(initial=0)
            kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
            for at in range(0, len(own), size):
                to = at + size
                out.append((ident[at:to].tobytes(), x[at:to].astype(kind).tobytes(), kind, dim, near[at:to].tobytes()))
        types = (pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(types)], names=["ids", "vectors", "kind", "dim", "near"])

    return map_batches(df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("long"), F.col(emb).cast("array<double>")), pack, PACKED)


def top_k(rows: DataFrame, queries: DataFrame, k: int, vec: str = "vec_id", emb: str = "embedding", n_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows other than itself."""
    spark = rows.sparkSession
    sample = rows.filter(F.col(vec).isNotNull()).select(vec, emb).orderBy(F.xxhash64(vec), vec).limit(PIVOT_SAMPLE)
    pivots: dict[int, np.ndarray] = {}
    for r in _blocks(sample, vec, emb, PIVOT_SAMPLE).toLocalIterator():  # PIVOT_SAMPLE vectors at most
        x = Block(r.ids, r.vectors, r.kind, r.dim, r.near).x
        pivots[r.dim] = pick_pivots(np.concatenate([pivots[r.dim], x]) if r.dim in pivots else x, n_pivots)
    table_of = spark.sparkContext.broadcast(pivots)
    queries = queries.select(vec, emb)
    few = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = _blocks(queries.repartition(few, F.xxhash64(vec)), vec, emb, QUERY_BLOCK, table_of)
    asked = materialize(asked.withColumn("block", F.monotonically_increasing_id()), "queries")
    # every query block meets every row block of its length; row blocks of a query block are dealt over slices
    slices = max(1, shuffle_parts(spark))
    packed = _blocks(rows, vec, emb, ROW_BLOCK, table_of).withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    fan = asked.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("asks"), "ids", "vectors", "kind", "dim", "near")
    pairs = packed.join(fan.select("block", "slice", "dim"), ["slice", "dim"]).select("block", "slice", F.lit(False).alias("asks"), "ids", "vectors", "kind", "dim", "near")
    dealt = pairs.unionByName(fan).repartition(slices, "block", "slice").sortWithinPartitions("block", "slice", F.col("asks").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None

        def best(h: Held | None) -> Iterator[pa.RecordBatch]:
            if h is not None and h.size.any():
                q, j = np.nonzero(np.arange(k) < h.size[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(h.asked.ids[q]), pa.array(h.who[q, j]), pa.array(h.score[q, j])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r["ids"], r["vectors"], r["kind"], r["dim"], r["near"])
                if r["asks"]:
                    yield from best(held)
                    held, at = Held(block, k), (r["block"], r["slice"])
                elif held is not None and at == (r["block"], r["slice"]):
                    held.offer(block)
        yield from best(held)

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)
