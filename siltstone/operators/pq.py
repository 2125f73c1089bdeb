"""Product quantization: chunked codebooks, codes, and distances by table lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from siltstone.functions.vectors import chunks, minus, squared_l2
from siltstone.operators import tiles
from siltstone.sources.scratch import written


def chunked(base: DataFrame, center: DataFrame, dims: int, n: int) -> DataFrame:
    """(id, chunk, x): the centred vectors' chunks."""
    c = base.join(F.broadcast(center)).select("id", minus("v", "c").alias("v"))
    return c.select("id", F.posexplode(chunks("v", dims, n)).alias("chunk", "x"))


def fixed_codebook(parts: DataFrame, codes: int) -> DataFrame:
    """(chunk, code, w): the chunks of the vectors with ids below ``codes``."""
    return parts.filter(F.col("id") < codes).select("chunk", F.col("id").cast("int").alias("code"), F.col("x").alias("w"))


def encode(parts: DataFrame, codebook: DataFrame) -> DataFrame:
    """(id, chunk, code): the nearest centroid of each chunk, lowest code on a tie.

    A codebook has chunks times 256 rows at most, so each task holds it; distances
    are summed in component order, many vectors at once. A distance that is null, as
    of chunks of another width or with nulls, is the least, and NaN the greatest.
    """
    rows = codebook.select("chunk", "code", "w").collect()  # 256 a chunk at most
    fit = all(isinstance(t, IntegralType) for t in (parts.schema["chunk"].dataType, codebook.schema["code"].dataType))
    if not fit or not all(r.chunk is not None and r.code is not None and r.w and None not in r.w for r in rows):
        return _encode_plainly(parts, codebook)
    books = {}
    for c in sorted({r.chunk for r in rows}):
        own = sorted((r for r in rows if r.chunk == c), key=lambda r: r.code)
        if len({len(r.w) for r in own}) > 1:
            return _encode_plainly(parts, codebook)
        books[c] = np.array([r.code for r in own]), np.array([r.w for r in own], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, given = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            x = batch.column(2)
            size = x.value_lengths().fill_null(-1).to_numpy()
            if x.values.null_count:  # a chunk with a null has no distances
                size = np.where([v.is_valid and v.values.null_count > 0 for v in x], -1, size)
            first, flat = x.offsets.to_numpy()[:-1].astype(np.int64), x.values.to_numpy(zero_copy_only=False)
            code, known = np.zeros(len(chunk), np.int64), np.zeros(len(chunk), bool)
            for c in np.unique(chunk).tolist():
                if c not in books:
                    continue
                codes, w = books[c]
                mine = (chunk == c) & given
                known |= mine
                code[mine] = codes[0]
                at = np.flatnonzero(mine & (size == w.shape[1]))
                d = np.zeros((len(at), len(w)))
                for j, own in enumerate(w.T):
                    d += (flat[first[at] + j].astype(np.float64)[:, None] - own) ** 2
                least = np.fmin.reduce(d, axis=1)
                code[at] = codes[((d == least[:, None]) | np.isnan(least)[:, None]).argmax(1)]
            known = pa.array(known)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(known), batch.column(1).filter(known), pa.array(code).filter(known).cast(kind)], names=["id", "chunk", "code"])

    schema = StructType([parts.schema["id"], parts.schema["chunk"], codebook.schema["code"]])
    kind = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64"}[codebook.schema["code"].dataType.simpleString()]
    return parts.select("id", "chunk", "x").mapInArrow(run, schema)


def _encode_plainly(parts: DataFrame, codebook: DataFrame) -> DataFrame:
    """``encode`` for codebooks of any shape, by expressions inside the row."""
    book = codebook.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("code", "w"))).alias("book"))
    near = F.array_min(F.transform("book", lambda b: F.struct(squared_l2("x", b["w"]).alias("d"), b["code"].alias("code"))))
    return parts.join(F.broadcast(book), "chunk").select("id", "chunk", near["code"].alias("code"))


def lloyd_step(parts: DataFrame, codebook: DataFrame, digits: int = 9) -> DataFrame:
    """(chunk, code, dim, mean) after one round; a code without vectors keeps its centroid."""
    own = parts.join(encode(parts, codebook), ["id", "chunk"]).select("chunk", "code", F.posexplode("x").alias("dim", "v"))
    moved = own.groupBy("chunk", "code", "dim").agg(F.round(F.avg("v"), digits).alias("mean"))
    kept = codebook.select("chunk", "code", F.posexplode("w").alias("dim", "old"))
    return kept.join(moved, ["chunk", "code", "dim"], "left").select("chunk", "code", "dim", F.coalesce("mean", F.round("old", digits)).alias("mean"))


def train(parts: DataFrame, codes: int = 256, rounds: int = 12, seed: int = 42) -> DataFrame:
    """(chunk, code, w) by k-means: spread-out starts, then rounds of means. One task a chunk.

    ``parts`` is a bounded sample of vectors; fewer vectors than codes give fewer codes.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("id")["x"].to_list())
        r = np.random.default_rng(seed + int(pdf["chunk"].iloc[0]))
        own = [x[r.integers(len(x))]]
        far = ((x - own[0]) ** 2).sum(1)
        while len(own) < min(codes, len(x)) and far.sum() > 0:
            own.append(x[r.choice(len(x), p=far / far.sum())])
            far = np.minimum(far, ((x - own[-1]) ** 2).sum(1))
        c = np.array(own)
        for _ in range(rounds):
            near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
            n = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "code": np.arange(len(c), dtype=np.int32), "w": list(c)})

    return parts.groupBy("chunk").applyInPandas(fit, "chunk int, code int, w array<double>")


def distance_table(query_parts: DataFrame, codebook: DataFrame) -> DataFrame:
    """(qid, chunk, code, d): a query's chunk distances to every centroid."""
    q = query_parts.withColumnRenamed("id", "qid")
    return q.join(F.broadcast(codebook), "chunk").select("qid", "chunk", "code", squared_l2("x", "w").alias("d"))


def by_table(table: DataFrame, codes: DataFrame, digits: int = 9) -> DataFrame:
    """(qid, id, dist): sums of table entries over the chunks' codes."""
    return codes.join(table, ["chunk", "code"]).groupBy("qid", "id").agg(F.round(F.sum("d"), digits).alias("dist"))


class _Lookups(tiles.Best):
    """Rows of least table sums: a matrix product tells which may be, these are summed in chunk order; sums that may round to the k-th's stay, and of equal sums the k smallest ids."""

    def __init__(self, qids: np.ndarray, table: np.ndarray, k: int, digits: int):
        super().__init__(len(table), k)
        self.qids, self.table, self.unit = qids, table, 1.5 * 10.0**-digits
        self.slack = 64 * np.finfo(np.float64).eps * np.abs(table).sum(1)  # of the product

    def add(self, ids: np.ndarray, slots: np.ndarray) -> None:
        step, slots = max(self.k + 1, tiles.TILE // len(self.qids)), slots.astype(np.int64)
        for a in range(0, len(ids), step):
            part = slots[a : a + step]
            chosen = np.zeros((len(part), self.table.shape[1]))
            chosen[np.arange(len(part))[:, None], part] = 1
            near = self.table @ chosen.T  # in another order than by chunks
            most = self.far + self.slack
            new = np.flatnonzero(np.isinf(self.far))
            if len(new) and near.shape[1] > self.k:
                most[new] = self.upto(np.partition(near[new], self.k - 1, axis=1)[:, self.k - 1] + self.slack[new]) + self.slack[new]
            row, col = np.divmod(tiles.places(near <= most[:, None]), near.shape[1])
            dist = np.zeros(len(row))
            for slot in part.T:
                dist += self.table[row, slot[col]]
            own = dist <= self.far[row]
            super().add(row[own], ids[a : a + step][col[own]], dist[own])

    def upto(self, dist: np.ndarray) -> np.ndarray:
        return dist + self.unit + np.abs(dist) * 1e-14

    def kept(self, row: np.ndarray, dist: np.ndarray) -> np.ndarray:
        at = np.arange(len(row))
        last = at - np.searchsorted(row, row) == self.k - 1
        self.far[row[last]] = self.upto(dist[last])
        fresh = np.append(True, (row[1:] != row[:-1]) | (dist[1:] != dist[:-1]))[: len(row)]
        return (dist <= self.far[row]) & (at - np.maximum.accumulate(np.where(fresh, at, 0)) < self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        row, ident, dist = self.held
        return self.qids[row], ident, dist


def nearest_by_table(table: DataFrame, codes: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(qid, rank, id, dist): each query's k rows of least ``by_table`` sums, ties to the smaller id.

    All queries meet all rows in cells, where sums are matrix products of tables and chosen codes; queries without a
    number for every code of the table, and rows without one code a chunk, go by ``by_table``.
    """
    kinds = table.schema["qid"].dataType, codes.schema["id"].dataType
    table, codes = table.select("qid", "chunk", "code", "d"), codes.select("id", "chunk", "code")
    pairs = [by_table(table, codes, digits)]
    if all(isinstance(x, IntegralType) for x in kinds):
        ask = written(table.groupBy(F.col("qid").alias("id")).agg(F.sort_array(F.collect_list(F.struct("chunk", "code", "d"))).alias("t")), "lookup")
        slots = sorted((int(r.chunk), int(r.code)) for r in ask.select(F.explode("t").alias("t")).select("t.chunk", "t.code").distinct().dropna().collect())  # 256 a chunk at most
        of_chunk = sorted({c for c, _ in slots})
        known = table.sparkSession.createDataFrame([(c, x, i) for i, (c, x) in enumerate(slots)], "chunk int, code int, slot int")
        coded = codes.join(F.broadcast(known), ["chunk", "code"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk", "slot"))).alias("s"))
        coded = written(coded, "coded")
        longs = lambda x: F.array(*(F.lit(i).cast("long") for i in x))
        same = F.expr("transform(t, x -> CAST(x.chunk AS LONG))") == longs(c for c, _ in slots)
        same &= F.expr("transform(t, x -> CAST(x.code AS LONG))") == longs(x for _, x in slots)
        ask = ask.select("id", F.expr("transform(t, x -> CAST(x.d AS DOUBLE))").alias("v"), F.coalesce(same, F.lit(False)).alias("same"))
        ask = ask.withColumn("same", F.col("same") & tiles.regular(len(slots)))
        rows = coded.select("id", F.expr("transform(s, x -> CAST(x.slot AS DOUBLE))").alias("v"), (F.expr("transform(s, x -> CAST(x.chunk AS LONG))") == longs(of_chunk)).alias("same"))
        rows = rows.withColumn("same", F.col("same") & tiles.regular(len(of_chunk)))
        n, pairs = ask.filter("same").count(), []
        if n:
            clean = [df.filter("same").select(F.col("id").cast("long").alias("id"), "v") for df in (rows, ask)]
            own = tiles.cells(*clean, n, lambda qids, q: _Lookups(qids, q, k, digits))
            pairs.append(own.select(F.col("qid").cast(kinds[0]).alias("qid"), F.col("id").cast(kinds[1]).alias("id"), F.round("dist", digits).alias("dist")))
        odd = [df.filter("NOT same").select(F.col("id").alias("odd")) for df in (rows, ask)]
        if not n or not odd[1].isEmpty():
            pairs.append(by_table(table.join(odd[1], F.col("qid").eqNullSafe(F.col("odd")), "left_semi"), codes, digits))
        if n and not odd[0].isEmpty():
            fit = table.join(ask.filter("same").select(F.col("id").alias("odd")), F.col("qid") == F.col("odd"), "left_semi")
            pairs.append(by_table(fit, codes.join(odd[0], F.col("id").eqNullSafe(F.col("odd")), "left_semi"), digits))
    dist = pairs[0]
    for more in pairs[1:]:
        dist = dist.unionByName(more)
    best = Window.partitionBy("qid").orderBy(F.col("dist").asc_nulls_last(), F.col("id").asc_nulls_last())
    return dist.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "rank", "id", "dist")
