"""Exact nearest neighbours, centres, and recall."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siltstone.functions.vectors import minus, squared_l2
from siltstone.operators import tiles


class _Nearest(tiles.Best):
    """Rows whose distance by a matrix product may be among the k least; of these the distance is summed in component order.

    Products are in single precision, unless numbers are too large for it or its
    error lets many rows through; then in double.
    """

    #: Rows that queries meet at once.
    WIDE = 2048

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, skip_self: bool):
        super().__init__(len(q), k)
        self.qids, self.skip_self = qids, skip_self
        self.order = np.argsort(qids, kind="stable")
        self.by_dim, self.norm = np.ascontiguousarray(q.T), (q * q).sum(1)
        self.product = np.hstack([-2 * q, np.ones((len(q), 1))])
        self.short = self.product.astype(np.float32) if self.norm.max() < 1e30 else None

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(ids), max(self.k + 1, self.WIDE)):
            self._tiles(ids[a : a + max(self.k + 1, self.WIDE)], x[a : a + max(self.k + 1, self.WIDE)])

    def _near(self, at: slice, y: np.ndarray, own: tuple[np.ndarray, np.ndarray], top: float, short: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """(query, row) of a tile that may be near; None if single precision lets many through."""
        near = (self.short if short else self.product)[at] @ y  # less the query's squared length
        near[own[0] - at.start, own[1]] = np.inf
        # of the product, a multiple of its error; what single precision has no numbers for is below the last term
        slack = (2 if short else 8) * (len(y) + 3) * np.finfo(y.dtype).eps * (self.norm[at] + top) + (1e-30 if short else 0)
        most = self.far[at] - self.norm[at] + slack
        new = np.flatnonzero(np.isinf(self.far[at]))
        if len(new) and near.shape[1] > self.k:
            most[new] = np.partition(near[new], self.k - 1, axis=1)[:, self.k - 1] + 2 * slack[new]
        most = np.nextafter(most.astype(y.dtype), y.dtype.type(np.inf))
        may = near <= most[:, None]
        if short and np.count_nonzero(may) > 4 * self.k * len(may) + may.size // 64:
            return None
        row, col = np.divmod(tiles.places(may), may.shape[1])
        return row + at.start, col

    def _tiles(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = (x * x).sum(1)
        y, top = np.vstack([x.T, norm]), norm.max()
        short = y.astype(np.float32) if self.short is not None and top < 1e30 else None
        own = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.skip_self:
            lo, hi = (np.searchsorted(self.qids, ids, side, sorter=self.order) for side in ("left", "right"))
            n = hi - lo
            own = self.order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(ids)), n)
            by = np.argsort(own[0], kind="stable")
            own = own[0][by], own[1][by]
        found = []
        step = max(1, tiles.TILE // len(ids))
        for a in range(0, len(self.qids), step):
            at = slice(a, a + step)
            mine = slice(*np.searchsorted(own[0], [a, a + step]))
            met = None
            if short is not None:
                met = self._near(at, short, (own[0][mine], own[1][mine]), top, True)
                if met is None:
                    self.short = short = None
            found.append(met or self._near(at, y, (own[0][mine], own[1][mine]), top, False))
        row, col = map(np.concatenate, zip(*found, strict=True))
        if self.skip_self:
            other = self.qids[row] != ids[col]
            row, col = row[other], col[other]
        dist = np.zeros(len(row))
        for q, v in zip(self.by_dim, y, strict=False):
            d = q[row] - v[col]
            dist += d * d
        own = dist <= self.far[row]
        super().add(row[own], ids[col[own]], dist[own])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        row, ident, dist = self.held
        return self.qids[row], ident, dist


def nearest(base: DataFrame, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(qid, rank, id, dist) of each query's k nearest rows of (id, v) by squared distance, ties to the smaller id.

    Queries are a stated set against all rows; they meet in cells, by matrix
    products, and each cell keeps k rows a query. Vectors that are null, of another
    length or hold what is no finite number go a plain way, pair by pair; a distance
    that is null comes last.
    """
    base, queries = base.select("id", "v"), queries.select("id", "v")
    kinds = base.schema["id"].dataType, queries.schema["id"].dataType
    n, dims = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    fit = tiles.regular(dims) if dims and dims > 0 and all(isinstance(x, IntegralType) for x in kinds) else F.lit(False)
    odd = [df.filter(~fit) for df in (base, queries)]
    n_odd = [df.count() for df in odd]
    pairs = []
    if n > n_odd[1]:
        clean = [df.filter(fit).select(F.col("id").cast("long").alias("id"), "v") for df in (base, queries)]
        own = tiles.cells(*clean, n - n_odd[1], lambda qids, q: _Nearest(qids, q, k, skip_self))
        pairs.append(own.select(F.col("qid").cast(kinds[1]).alias("qid"), F.col("id").cast(kinds[0]).alias("id"), "dist"))
    plain = ([(odd[0], queries)] if n_odd[0] else []) + ([(base.filter(fit), odd[1])] if n_odd[1] else [])
    for rows, asked in plain or ([] if pairs else [(base, queries)]):
        met = rows.join(asked.select(F.col("id").alias("qid"), F.col("v").alias("qv")))
        met = met.filter("id <> qid") if skip_self else met
        pairs.append(met.select("qid", "id", squared_l2("qv", "v").alias("dist")))
    dist = pairs[0]
    for more in pairs[1:]:
        dist = dist.unionByName(more)
    best = Window.partitionBy("qid").orderBy(F.col("dist").asc_nulls_last(), F.col("id").asc_nulls_last())
    return dist.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def mean(base: DataFrame, digits: int | None = None) -> DataFrame:
    """(dim, mean) over all vectors; map-side sums for each component."""
    m = F.avg(F.col("x").cast("double"))
    return base.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg((F.round(m, digits) if digits is not None else m).alias("mean"))


def center(base: DataFrame, digits: int | None = None) -> DataFrame:
    """One row (c): the mean as an array; it has as many numbers as a vector."""
    return mean(base, digits).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("c"))


def medoid(base: DataFrame, digits: int | None = None) -> DataFrame:
    """The vector nearest to the mean, lowest id on a tie: (id, dist)."""
    near = base.join(F.broadcast(center(base, digits))).select("id", squared_l2("v", "c").alias("dist"))
    return near.orderBy("dist", "id").limit(1)


def total_medoid(base: DataFrame, digits: int = 6) -> DataFrame:
    """The vector of least total squared distance to all: (id, total), lowest id on a tie.

    With any c, the total of x is n |x - c|^2 - 2 (x - c) r + s, where r is the sum of
    all y - c and s that of |y - c|^2; c is the mean, so that little cancels. Only
    vectors that are not regular meet all others pair by pair; a total that is null comes last.
    """
    base = base.select("id", "v")
    dims = base.agg(F.max(F.size("v"))).first()[0] or 0
    fit = tiles.regular(dims) if dims > 0 else F.lit(False)
    clean, odd = base.filter(fit), base.filter(~fit)
    off = clean.join(F.broadcast(center(clean))).select("id", minus("v", "c").alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)
    rest = off.select(F.posexplode("x").alias("dim", "x")).groupBy("dim").agg(F.sum("x").alias("r")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "r"))), lambda s: s["r"]).alias("r"))
    sums = off.agg(F.count("*").alias("n"), F.sum(square).alias("s")).join(F.broadcast(rest))
    product = F.aggregate(F.zip_with("x", "r", lambda x, r: x * r), F.lit(0.0), lambda s, x: s + x)
    totals = off.join(F.broadcast(sums)).select("id", (F.col("n") * square - 2 * product + F.col("s")).alias("d"))
    if not odd.isEmpty():
        meet = lambda a, b: a.join(b.select(F.col("v").alias("ov"))).select("id", squared_l2("v", "ov").alias("d"))
        totals = totals.unionByName(meet(odd, base)).unionByName(meet(clean, odd))
    totals = totals.groupBy("id").agg(F.round(F.sum("d"), digits).alias("total"))
    return totals.orderBy(F.col("total").asc_nulls_last(), F.col("id").asc_nulls_last()).limit(1)


def sample(base: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A fixed pseudo-random sample of n vectors, or all: the smallest keyed hashes of ids."""
    return base.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(seed))), "id").limit(n)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the k true neighbours that were found; an id counts once."""
    hits = found.filter(F.col("rank") <= k).select("qid", "id").distinct().join(truth.filter(F.col("rank") <= k).select("qid", "id"), ["qid", "id"], "left_semi")
    n = hits.groupBy("qid").agg(F.count("*").alias("n"))
    return truth.select("qid").distinct().join(n, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / k).alias("recall"))


def search_report(found: DataFrame, truth: DataFrame, k: int, seconds: float) -> DataFrame:
    """One row: queries, their mean and least recall, and queries a second."""
    n = F.count("*")
    return recall(found, truth, k).agg(n.alias("n_queries"), F.round(F.avg("recall"), 9).alias("mean_recall"), F.min("recall").alias("least_recall"), (n / F.lit(seconds)).alias("per_second"))
