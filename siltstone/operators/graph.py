"""Proximity graphs: pruning, building by shards, breadth-first levels, beam search.

A graph is built in shards of about ``SHARD`` vectors, each in one task, and a
query is answered in every shard and merged; memory follows the shard, not the
table. Graphs depend on no thread order: the visiting order is a seeded permutation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siltstone.sources.scratch import written

#: Vectors in a shard, degree, list sizes of build and search, pruning factor, most candidates, beam; usual defaults.
SHARD, DEGREE, BUILD_LIST, SEARCH_LIST, ALPHA, CANDIDATES, BEAM = 4_000, 64, 100, 100, 1.2, 500, 4
LEAST = 256
#: How far a list of reverse links may grow before it is pruned again.
SLACK = 1.3
#: Nodes that are put into a graph at once, numbers of a matrix in pruning and in search.
BATCH, CELL = 256, 1 << 22
#: Edges that one task walks level by level.
WALKED = 1 << 21


def robust_prune(x: np.ndarray, node: int, candidates: np.ndarray, degree: int, alpha: float, most: int = CANDIDATES) -> list[int]:
    """Neighbours of a node, few in each direction.

    Rounds of a growing factor take candidates, nearest first, unless one taken
    before is nearer to them by more than the factor (on squared distances); one that
    a nearer candidate shades by ``alpha`` or more, or that is a copy of one, is out
    of all rounds. With a factor above 1 the nearest left over, copies too, fill the
    degree.
    """
    own = np.unique(candidates[candidates != node])
    d = ((x[own] - x[node]) ** 2).sum(1)
    order = np.lexsort((own, d))[:most]
    own, d = own[order], d[order]
    shade, taken = np.zeros(len(own)), []
    factor = 1.0
    while factor <= alpha + 1e-6 and len(taken) < degree:
        for i in range(len(own)):
            if len(taken) >= degree:
                break
            if shade[i] > factor:
                continue
            taken.append(i)
            shade[i] = np.inf
            later = i + 1 + np.flatnonzero(shade[i + 1 :] < alpha)
            between = ((x[own[later]] - x[own[i]]) ** 2).sum(1)
            ratio = np.divide(d[later], between, out=np.full(len(later), np.inf), where=between > 0)
            shade[later] = np.maximum(shade[later], ratio)
        factor *= 1.2
    if alpha > 1:
        have = set(taken)
        taken += [i for i in range(len(own)) if i not in have][: degree - len(taken)]
    return own[taken].tolist()


def prune_rows(y: np.ndarray, d: np.ndarray, ident: np.ndarray, held: np.ndarray, degree: int, alpha: float, exact: bool = True, most: int = CANDIDATES) -> np.ndarray:
    """``robust_prune`` of many nodes at once: (nodes, degree) places of what is kept, -1 where there is no more.

    ``y`` holds the candidates' vectors (nodes, candidates, dims), ``d`` their squared
    distances to the node, ``ident`` what decides ties, ``held`` which places are in
    use; of those with one ``ident`` one counts. Distances between candidates are
    summed from differences, or else come from one matrix product; then ``y`` should
    be relative to the node.
    """
    order = np.lexsort((ident, np.where(held, d, np.inf), ~held), axis=-1)
    ident, d, held = (np.take_along_axis(a, order, 1) for a in (ident, d, held))
    held = held.copy()
    held[:, 1:] &= (ident[:, 1:] != ident[:, :-1]) | ~held[:, :-1]
    keep = held & (np.cumsum(held, 1) <= most)
    y = np.take_along_axis(y, order[:, :, None], 1)
    if not exact:
        product = y @ y.transpose(0, 2, 1)
        square = np.einsum("ncc->nc", product).copy()
    rows, places = np.arange(len(d)), np.arange(d.shape[1])
    shade, taken, n = np.where(keep, 0.0, np.inf), np.full((len(d), degree), -1), np.zeros(len(d), np.int64)
    factor = 1.0
    while factor <= alpha + 1e-6 and (n < degree).any():
        at, live = np.zeros(len(d), np.int64), rows[n < degree]
        while len(live):
            free = ~(shade[live] > factor) & (places >= at[live, None])
            i = free.argmax(1)
            more = free[np.arange(len(live)), i]
            live, i = live[more], i[more]
            taken[live, n[live]] = i
            n[live] += 1
            at[live] = i + 1
            shade[live, i] = np.inf
            if exact:
                between = ((y[live] - y[live, i][:, None]) ** 2).sum(-1)
            else:
                between = square[live] + square[live, i][:, None] - 2 * product[live, i]
            ratio = np.divide(d[live], between, out=np.full(between.shape, np.inf), where=between > 0)
            own = shade[live]
            shade[live] = np.where((places > i[:, None]) & (own < alpha), np.maximum(own, ratio), own)
            live = live[n[live] < degree]
        factor *= 1.2
    if alpha > 1:
        left = keep.copy()
        row, nth = np.nonzero(taken >= 0)
        left[row, taken[row, nth]] = False
        nth = np.cumsum(left, 1)
        row, i = np.nonzero(left & (nth <= (degree - n)[:, None]))
        taken[row, n[row] + nth[row, i] - 1] = i
    return np.where(taken >= 0, np.take_along_axis(order, np.maximum(taken, 0), 1), -1)


def _fresh(seen: np.ndarray, row: np.ndarray, node: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (row, node) that are not seen yet, each once; from now on they are."""
    key = row * seen.shape[1] + node
    key = key[~seen.ravel()[key]]
    mark.ravel()[key] = np.arange(len(key), dtype=mark.dtype)
    key = key[mark.ravel()[key] == np.arange(len(key))]
    seen.ravel()[key] = True
    return key // seen.shape[1], key % seen.shape[1]


def walk(links: np.ndarray, starts: np.ndarray, rows: int, size: int, width: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many rows at once: (row, node) of all that were expanded.

    Each step expands a row's ``width`` nearest open nodes among the ``size`` nearest
    found, by ``near(row, node)``; ``links`` (nodes, most) holds -1 where there is none.
    """
    seen, mark = np.zeros((rows, len(links)), bool), np.zeros((rows, len(links)), np.int32)
    ids, d, shut = np.full((rows, size), -1), np.full((rows, size), np.inf), np.ones((rows, size), bool)
    row, node = _fresh(seen, np.repeat(np.arange(rows), len(starts)), np.tile(starts, rows), mark)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        if len(row):  # what is new goes behind what is held
            order = np.argsort(row, kind="stable")
            row, node = row[order], node[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            wide = rows, int(nth.max()) + 1
            ids, d, shut = (np.hstack([old, np.full(wide, x, old.dtype)]) for old, x in ((ids, -1), (d, np.inf), (shut, True)))
            ids[row, size + nth], d[row, size + nth], shut[row, size + nth] = node, near(row, node), False
            best = np.argsort(d, axis=1, kind="stable")[:, :size]
            ids, d, shut = (np.take_along_axis(x, best, 1) for x in (ids, d, shut))
        front = ~shut
        row, at = np.nonzero(front & (np.cumsum(front, 1) <= width))
        if not len(row) or most is not None and len(out) >= most:
            break
        shut[row, at] = True
        out.append((row, ids[row, at]))
        to = links[out[-1][1]]
        own, at = np.nonzero(to >= 0)
        row, node = _fresh(seen, row[own], to[own, at].astype(np.int64), mark)
    return np.concatenate([r for r, _ in out]), np.concatenate([i for _, i in out])


def _relink(x: np.ndarray, nodes: np.ndarray, row: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(nodes, degree) pruned links of nodes x[nodes[row]] with candidates x[cand], -1 where there is no more."""
    own = nodes[row] != cand
    row, cand = row[own], cand[own]
    order = np.argsort(row, kind="stable")
    row, cand = row[order], cand[order]
    count, first = np.bincount(row, minlength=len(nodes)), np.searchsorted(row, np.arange(len(nodes)))
    out = np.full((len(nodes), degree), -1)
    by = np.argsort(count, kind="stable")
    by = by[count[by] > 0]
    while len(by):  # those of most candidates first, as many as fit
        wide = int(count[by[-1]])
        now, by = by[-max(1, CELL // (wide * max(wide, x.shape[1]))) :], by[: -max(1, CELL // (wide * max(wide, x.shape[1])))]
        at = np.arange(wide)
        held = at < count[now, None]
        ids = np.where(held, cand[np.minimum(first[now, None] + at, len(cand) - 1)], -1)
        y = x[ids] - x[nodes[now], None]
        kept = prune_rows(y, (y * y).sum(-1), ids, held, degree, alpha, exact=False)
        out[now] = np.where(kept >= 0, np.take_along_axis(ids, np.maximum(kept, 0), 1), -1)
    return out


def vamana(x: np.ndarray, degree: int, size: int, alpha: float, seed: int = 42) -> tuple[list[np.ndarray], int]:
    """Links of every node, and the start: the vector nearest to the mean.

    Nodes come in batches, as many as are there already and ``BATCH`` at most; a
    batch searches the graph as it was before, and its nodes are candidates of each other.
    """
    n = len(x)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    most = math.ceil(SLACK * degree)
    links, count = np.full((n, most), -1, np.int32), np.zeros(n, np.int64)

    def put(nodes: np.ndarray, own: np.ndarray) -> None:
        links[nodes] = -1
        links[nodes, : own.shape[1]] = own
        count[nodes] = (own >= 0).sum(1)

    def linked(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, at = np.nonzero(links[nodes] >= 0)
        return row, links[nodes[row], at].astype(np.int64)

    order, done = np.random.default_rng(seed).permutation(n), 0
    while done < n:
        nodes = order[done : done + min(max(1, done), BATCH)]
        done += len(nodes)
        q = x[nodes]
        pairs = [walk(links, np.array([start]), len(nodes), size, BEAM, lambda row, node, q=q: ((x[node] - q[row]) ** 2).sum(1)), linked(nodes)]
        mates = min(degree, len(nodes) - 1)
        if mates:
            y = q - q.mean(0)
            near = (y * y).sum(1) - 2 * y @ y.T
            np.fill_diagonal(near, np.inf)
            pairs.append((np.repeat(np.arange(len(nodes)), mates), nodes[np.argpartition(near, mates - 1, axis=1)[:, :mates]].ravel()))
        put(nodes, _relink(x, nodes, *map(np.concatenate, zip(*pairs, strict=True)), degree, alpha))
        row, other = linked(nodes)
        new = (links[other] != nodes[row, None]).all(1)
        back = np.argsort(other[new], kind="stable")
        other, node = other[new][back], nodes[row[new][back]]
        nth = np.arange(len(other)) - np.searchsorted(other, other)
        more = np.bincount(other, minlength=n)
        fits = count[other] + more[other] <= most
        links[other[fits], count[other[fits]] + nth[fits]] = node[fits]
        full = np.unique(other[~fits])
        if len(full):
            pairs = [linked(full), (np.searchsorted(full, other[~fits]), node[~fits])]
            own = _relink(x, full, *map(np.concatenate, zip(*pairs, strict=True)), degree, alpha)
        count[other[fits]] += more[other[fits]]
        if len(full):
            put(full, own)
    full = np.flatnonzero(count > degree)
    if len(full):
        put(full, _relink(x, full, *linked(full), degree, alpha))
    return [own[:k] for own, k in zip(links, count.tolist(), strict=True)], start


def _by(key: str, make: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``make`` of each group of a partition; partitions hold a group each, so that groups run beside each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            for _, own in pd.concat(held, ignore_index=True).groupby(key):
                yield make(own)

    return run


def build(base: DataFrame, degree: int = DEGREE, size: int = BUILD_LIST, alpha: float = ALPHA, shard: int | None = None) -> DataFrame:
    """(shard, id, v, nbrs, is_start) from (id, v); neighbours are of the same shard.

    A shard holds ``SHARD`` vectors at most, fewer where that keeps all cores at
    work, but not below ``LEAST``.
    """
    n = base.count()
    if shard is None:
        shard = min(SHARD, max(LEAST, -(-n // base.sparkSession.sparkContext.defaultParallelism)))
    shards = max(1, -(-n // shard))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x, ids = np.stack(pdf["v"].to_list()).astype(np.float64), pdf["id"].to_numpy()
        links, start = vamana(x, degree, size, alpha)
        return pd.DataFrame({"shard": pdf["shard"], "id": ids, "v": pdf["v"], "nbrs": [ids[own].tolist() for own in links], "is_start": np.arange(len(ids)) == start})

    dealt = base.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", F.col("v").cast("array<float>").alias("v"))
    dealt = dealt.repartitionById(shards, F.col("shard").cast("int"))
    return dealt.mapInPandas(_by("shard", make), "shard long, id long, v array<float>, nbrs array<long>, is_start boolean")


def beam(x: np.ndarray, links: np.ndarray, steer: np.ndarray, q: np.ndarray, starts: list[int], k: int, size: int, width: int, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, dist): each query's k nearest of all its expanded nodes by exact distance; ``steer`` (nodes, queries), approximate distances, chooses whom to expand.

    Start nodes are dealt over the probes in turn; a node that several find counts once.
    """
    found = [walk(links, np.array(starts[p::probes] or starts[:1]), len(q), size, width, lambda row, node: steer[node, row], max(50, size // width * 2)) for p in range(probes)]
    row, node = np.divmod(np.unique(np.concatenate([r * len(x) + i for r, i in found])), len(x))
    dist = ((x[node] - q[row]) ** 2).sum(1)
    order = np.lexsort((node, dist, row))
    row, node, dist = row[order], node[order], dist[order]
    own = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[own], node[own], dist[own]


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, size: int = SEARCH_LIST, width: int = BEAM, probes: int = 1, codes: int = 256, chunks: int = 16,
    codebook: DataFrame | None = None, coded: DataFrame | None = None, center: DataFrame | None = None, entries: DataFrame | None = None,
) -> DataFrame:
    """(qid, rank, id, dist): beam search of every shard, steered by product-quantized distances, merged.

    With ``codebook`` (chunk, code, w), ``center`` (c) and ``coded`` (id, codes) the
    stored codes steer, else each shard fits a small codebook of its own. ``entries``
    (id) are further starts, the shard's own start comes first; they are dealt over
    the probes. Queries (id, v) are dealt to all shards in blocks; a shard and a
    block are in one task's memory.
    """
    from siltstone.functions.vectors import chunk_offsets

    per_block = 5000
    known = sorted(r.shard for r in index.select("shard").distinct().collect())  # one for 256 vectors at most
    if not known:
        return index.sparkSession.createDataFrame([], "qid long, rank int, id long, dist double")
    blocks = max(1, -(-queries.count() // per_block))
    nth = F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(known) for x in (s, i))), F.col("shard"))
    if coded is not None:
        index = index.join(coded.select("id", "codes"), "id")
    if entries is not None:
        own = entries.select(F.col("id").alias("entry")).distinct()
        index = index.join(F.broadcast(own), F.col("id") == F.col("entry"), "left").withColumn("is_start", F.col("is_start") | F.col("entry").isNotNull()).drop("entry")
    none = lambda kind: F.lit(None).cast(kind)
    nodes = index.select(F.explode(F.sequence(nth * blocks, nth * blocks + F.lit(blocks - 1))).alias("cell"), F.lit(False).alias("asks"), "id", "v", "nbrs", (F.col("codes") if coded is not None else none("array<int>")).alias("codes"), "is_start")
    to = F.sequence(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.lit(len(known) * blocks - 1), F.lit(blocks))
    asked = queries.select(F.explode(to).alias("cell"), F.lit(True).alias("asks"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"), none("array<long>").alias("nbrs"), none("array<int>").alias("codes"), none("boolean").alias("is_start"))
    cells = nodes.unionByName(asked).repartitionById(len(known) * blocks, "cell")
    stored = None
    if codebook is not None:  # 256 rows a chunk at most
        rows = codebook.orderBy("chunk", "code").collect()
        books = [np.array([r.w for r in rows if r.chunk == c]) for c in sorted({r.chunk for r in rows})]
        stored = index.sparkSession.sparkContext.broadcast((books, np.array(center.first().c)))

    def fitted(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        at = chunk_offsets(x.shape[1], min(chunks, x.shape[1]))
        mean = x.mean(0)
        r = np.random.default_rng(42)
        books, code = [], []
        for a, b in zip(at, at[1:], strict=False):
            part = x[:, a:b] - mean[a:b]
            c = part[r.choice(len(x), min(codes, len(x)), replace=False)]
            for _ in range(4):
                near = ((c**2).sum(1) - 2 * part @ c.T).argmin(1)
                n = np.bincount(near, minlength=len(c))
                sums = np.zeros_like(c)
                np.add.at(sums, near, part)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            books.append(c)
            code.append(((c**2).sum(1) - 2 * part @ c.T).argmin(1))
        return books, mean, np.stack(code, 1)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        own, ask = (cell[cell["asks"] == x].sort_values("id") for x in (False, True))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(own) and len(ask):
            x, ids = np.stack(own["v"].to_list()).astype(np.float64), own["id"].to_numpy()
            n_links = own["nbrs"].map(len).to_numpy()
            links = np.full((len(x), max(1, n_links.max())), -1, np.int32)
            links[np.arange(links.shape[1]) < n_links[:, None]] = np.searchsorted(ids, np.concatenate(own["nbrs"].to_list()))
            starts = np.flatnonzero(own["is_start"].to_numpy(dtype=bool)).tolist() or [0]
            books, mean, code = (*stored.value, np.stack(own["codes"].to_list())) if stored else fitted(x)
            at = np.cumsum([0, *(b.shape[1] for b in books)])
            qids, qs = ask["id"].to_numpy(), np.stack(ask["v"].to_list()).astype(np.float64)
            step = max(1, CELL // 4 // len(x))
            for a in range(0, len(qs), step):
                q = qs[a : a + step]
                steer = np.zeros((len(x), len(q)))
                for i, (b, c) in enumerate(zip(at, books, strict=False)):
                    part = q[:, b : b + c.shape[1]] - mean[b : b + c.shape[1]]
                    steer += ((c * c).sum(1)[:, None] - 2 * c @ part.T + (part * part).sum(1))[code[:, i]]
                row, node, dist = beam(x, links, steer, q, starts, k, size, width, probes)
                out.append((qids[a + row], ids[node], dist))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("qid", "id", "dist"), zip(*out, strict=True), strict=True)})

    found = cells.mapInPandas(_by("cell", run), "qid long, id long, dist double")
    best = Window.partitionBy("qid").orderBy("dist", "id")
    return found.dropDuplicates(["qid", "id"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def prune_table(base: DataFrame, candidates: DataFrame, degree: int, alpha: float) -> DataFrame:
    """(id, nbrs) pruned from (id, cands): a node and its candidates, with their vectors, follow each other, and many nodes are pruned at once."""
    pairs = candidates.select("id", F.explode("cands").alias("cid")).join(base.select(F.col("id").alias("cid"), "v"), "cid")
    own = base.join(candidates.select("id"), "id", "left_semi").select("id", F.lit(None).cast("long").alias("cid"), "v")
    sent = own.unionByName(pairs.select("id", F.col("cid").cast("long").alias("cid"), "v")).repartition("id").sortWithinPartitions(F.col("id"), F.col("cid").asc_nulls_first())

    def prune(ids: np.ndarray, cids: np.ndarray, mine: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        """Of whole groups; rows that are ``mine`` hold the node's own vector."""
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        cand = np.flatnonzero(~mine)
        group = group[cand]
        n, start = np.bincount(group, minlength=len(first)), np.searchsorted(group, np.arange(len(first)))
        node, nbrs = [], []
        by = np.argsort(n, kind="stable")
        by = by[(n[by] > 0) & mine[first[by]]]
        while len(by):  # those of most candidates first, as many as fit
            wide = int(n[by[-1]])
            fit = max(1, CELL // 4 // (wide * x.shape[1]))
            now, by = by[-fit:], by[:-fit]
            at = np.arange(wide)
            held = at < n[now, None]
            rows = cand[np.minimum(start[now, None] + at, len(cand) - 1)]
            y = x[rows]
            d = ((y - x[first[now], None]) ** 2).sum(-1)
            kept = prune_rows(y, d, np.broadcast_to(at, rows.shape), held, degree, alpha)
            node += ids[first[now]].tolist()
            nbrs += [cids[r[k[k >= 0]]].tolist() for r, k in zip(rows, kept, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(nbrs, pa.list_(pa.int64()))], names=["id", "nbrs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            ids, cids = batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy()
            mine, v = batch.column(1).is_null().to_numpy(zero_copy_only=False), batch.column(2)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if v.null_count or len(np.unique(np.diff(v.offsets.to_numpy()))) > 1:
                raise ValueError("vectors to prune must be of one length")
            now = ids, cids, mine, x.reshape(len(ids), -1)
            held = now if held is None else tuple(np.concatenate(p) for p in zip(held, now, strict=True))
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if cut:
                yield prune(*(p[:cut] for p in held))
                held = tuple(p[cut:] for p in held)
        if held is not None:
            yield prune(*held)

    return sent.mapInArrow(run, "id long, nbrs array<long>")


def bfs_levels(edges: DataFrame, start: DataFrame, most: int = 64, walked: int = WALKED) -> DataFrame:
    """(id, level) of the nodes that (src, dst) edges reach from (id), level by level; null is no node.

    Up to ``walked`` edges and starts are walked in one task, whose memory that bounds.
    Of more, each round joins only the newest level, drops what is known, and is
    written to the shared folder.
    """
    kind = start.schema["id"].dataType
    edges, start = edges.select("src", "dst").dropna(), start.select("id").dropna().distinct()
    fit = all(isinstance(x, IntegralType) for x in (kind, *(f.dataType for f in edges.schema)))
    if fit and edges.count() + start.count() <= walked:
        sent = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(False).alias("starts"))
        sent = sent.unionByName(start.select(F.col("id").cast("long").alias("src"), F.col("id").cast("long").alias("dst"), F.lit(True).alias("starts")))
        return sent.coalesce(1).mapInArrow(lambda batches: _walked(batches, most), "id long, level int").select(F.col("id").cast(kind).alias("id"), "level")
    known = start.withColumn("level", F.lit(0))
    front = known
    for level in range(1, most + 1):
        step = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = written(step.join(known.select("id"), "id", "left_anti").withColumn("level", F.lit(level)), "level")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def _walked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(id, level) from all (src, dst, starts); a start is an edge to itself."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if len(b)]
    if not held:
        return
    src, dst, starts = (np.concatenate(c) for c in zip(*held, strict=True))
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    src, dst = at[: len(src)], at[len(src) :]
    level, front = np.full(len(ids), -1, np.int32), np.unique(src[starts])
    order = np.argsort(src, kind="stable")
    first, to = np.searchsorted(src[order], np.arange(len(ids) + 1)), dst[order]
    for nth in range(most + 1):
        level[front] = nth
        n = first[front + 1] - first[front]
        met = to[np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        front = np.unique(met[level[met] < 0])
        if not len(front):
            break
    own = np.flatnonzero(level >= 0)
    for a in range(0, len(own), 1 << 16):
        now = own[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[now]), pa.array(level[now])], names=["id", "level"])


def entry_points(base: DataFrame, levels: DataFrame, n: int) -> DataFrame:
    """(nth, id): the start, then the farthest point from all before among the first 10 n nodes of the search order.

    The candidates are bounded by n, so they are handled in one task.
    """
    near = levels.orderBy("level", "id").limit(10 * n).join(base, "id").select("id", "level", "v")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["level", "id"])
        if not len(pdf):
            return
        x, ids = np.stack(pdf["v"].to_list()).astype(np.float64), pdf["id"].to_numpy()
        own, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(own) < min(n, len(x)):
            own.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[own[-1]]) ** 2).sum(1))
        yield pd.DataFrame({"nth": range(len(own)), "id": ids[own]})

    return near.coalesce(1).mapInPandas(pick, "nth int, id long")


def reorder(levels: DataFrame, base: DataFrame, width: int = 65536) -> DataFrame:
    """(id, place): nodes by level, unreached ones last, by id; ids stay, the place only sorts files.

    Nodes are numbered within ranges of ids of a level; only the ranges' counts meet.
    """
    every = base.select("id").join(levels, "id", "left").withColumn("level", F.coalesce("level", F.lit(1 << 30)))
    every = every.withColumn("part", F.floor(F.col("id") / width))
    sums = Window.orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = every.groupBy("level", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(sums), F.lit(0))).drop("n")
    within = Window.partitionBy("level", "part").orderBy("id")
    return every.withColumn("nth", F.row_number().over(within)).join(before, ["level", "part"]).select("id", (F.col("before") + F.col("nth") - 1).alias("place"))
