"""Vector queries over ``embeddings``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.vectors import chunk_offsets
from siltstone.operators import ann, graph, knn, pq
from siltstone.sources.binary import decode_vectors, vector_blobs
from siltstone.sources.scratch import fresh_dir, written
from siltstone.sources.tables import table

#: Dimensions, chunks and codes of the queries' codebook; queries ask every ASK_EVERY-th id.
DIMS, CHUNKS, CODES, ASK_EVERY, K = 64, 16, 16, 20, 10


def _base(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _asked(b: DataFrame) -> DataFrame:
    return b.filter(F.col("id") % ASK_EVERY == 0)


def knn_exact_l2(s: SparkSession, d: str) -> DataFrame:
    b = _base(s, d)
    return knn.nearest(b, _asked(b), K)


def knn_graph(s: SparkSession, d: str) -> DataFrame:
    b = _base(s, d)
    return knn.nearest(b, b, 4, skip_self=True)


def vec_mean(s: SparkSession, d: str) -> DataFrame:
    return knn.mean(_base(s, d), 9)


def vec_medoid(s: SparkSession, d: str) -> DataFrame:
    return knn.medoid(_base(s, d), 9).select("id", F.round("dist", 6).alias("dist"))


def vec_medoid_total(s: SparkSession, d: str) -> DataFrame:
    return knn.total_medoid(_base(s, d), 6)


def vec_sample(s: SparkSession, d: str) -> DataFrame:
    return knn.sample(_base(s, d), 100).select("id")


def _parts(s: SparkSession, d: str) -> DataFrame:
    b = _base(s, d)
    return pq.chunked(b, knn.center(b, 9), DIMS, CHUNKS)


def pq_encode(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d)
    return pq.encode(p, pq.fixed_codebook(p, CODES))


def pq_lloyd_step(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d)
    return pq.lloyd_step(p, pq.fixed_codebook(p, CODES), 6)


def pq_adc(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d)
    t = pq.distance_table(_asked(p), pq.fixed_codebook(p, CODES))
    return t.select("qid", "chunk", "code", F.round("d", 9).alias("d"))


def _by_codes(s: SparkSession, d: str) -> DataFrame:
    p = _parts(s, d)
    book = pq.fixed_codebook(p, CODES)
    return pq.nearest_by_table(pq.distance_table(_asked(p), book), pq.encode(p, book), K)


def pq_topk(s: SparkSession, d: str) -> DataFrame:
    return _by_codes(s, d).select("qid", "rank", "id")


def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    return knn.recall(_by_codes(s, d), knn_exact_l2(s, d), K)


def _edges(s: SparkSession, d: str) -> DataFrame:
    return written(knn_graph(s, d).select(F.col("qid").alias("src"), F.col("id").alias("dst")), "edges")


def graph_bfs_levels(s: SparkSession, d: str) -> DataFrame:
    return graph.bfs_levels(_edges(s, d), s.range(1).select("id"))


def graph_reorder(s: SparkSession, d: str) -> DataFrame:
    return graph.reorder(graph_bfs_levels(s, d), _base(s, d))


def entry_points(s: SparkSession, d: str) -> DataFrame:
    return graph.entry_points(_base(s, d), graph_bfs_levels(s, d), 5)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    b = _base(s, d)
    return written(knn.nearest(b, b, 40, skip_self=True).groupBy(F.col("qid").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("cands")), "candidates")


def robust_prune(s: SparkSession, d: str) -> DataFrame:
    return graph.prune_table(_base(s, d), _candidates(s, d), 12, 1.2)


def robust_prune_degrees(s: SparkSession, d: str) -> DataFrame:
    """Sizes of candidates and of what is kept of them; with a factor above 1 the degree is filled."""
    cands = _candidates(s, d)
    held = graph.prune_table(_base(s, d), cands, 12, 1.2).join(cands, "id").filter(F.size(F.array_except("nbrs", "cands")) == 0)
    return held.select("id", F.size("cands").alias("n_offered"), F.size(F.array_distinct("nbrs")).alias("n_kept"))


def pq_train(s: SparkSession, d: str) -> DataFrame:
    """Sizes of a trained codebook: codes and mean squared error a chunk."""
    b = knn.sample(_base(s, d), 500)
    p = pq.chunked(b, knn.center(b, 9), DIMS, CHUNKS)
    return pq.train(p, CODES, 12).groupBy("chunk").agg(F.count("*").alias("n_codes"))


def vamana_search(s: SparkSession, d: str) -> DataFrame:
    b = _base(s, d)
    return graph.search(written(graph.build(b, degree=24, size=50), "graph"), _asked(b), K, size=50)


def vamana_recall(s: SparkSession, d: str) -> DataFrame:
    return knn.recall(vamana_search(s, d), knn_exact_l2(s, d), K)


def vamana_enough(s: SparkSession, d: str) -> DataFrame:
    """Whether nine tenths of the true neighbours are found, over all queries."""
    return _enough(vamana_search(s, d), knn_exact_l2(s, d))


def _enough(found: DataFrame, truth: DataFrame) -> DataFrame:
    r = knn.recall(found, truth, K)
    return r.agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("enough"))


def _index(s: SparkSession, d: str) -> ann.Index:
    path = fresh_dir(s, "index")
    ann.build(_base(s, d), path, ann.Options(DIMS, CHUNKS, 32, degree=24, size=50, entries=6, devices=4))
    return ann.load(s, path)


def ann_search_recall(s: SparkSession, d: str) -> DataFrame:
    """An index built stage by stage, loaded with its checks and searched from its codes, entry points and two probes."""
    return _enough(_index(s, d).search(_asked(_base(s, d)), K, size=60, probes=2), knn_exact_l2(s, d))


def ann_artefacts(s: SparkSession, d: str) -> DataFrame:
    """Rows of each artefact of a built index; the first entry is the medoid."""
    index = _index(s, d)
    book = index.codebook.agg(F.count_distinct("chunk").alias("n"), F.lit("chunks").alias("name"))
    sizes = index.codes.agg(F.count("*").alias("n"), F.lit("codes").alias("name"))
    nodes = index.nodes.agg(F.count_distinct("id").alias("n"), F.lit("nodes").alias("name"))
    first = index.entries.filter(F.col("id") == index.medoid).agg(F.count("*").alias("n"), F.lit("medoid").alias("name"))
    entries = index.entries.agg(F.count("*").alias("n"), F.lit("entries").alias("name"))
    return book.unionByName(sizes).unionByName(nodes).unionByName(first).unionByName(entries)


def ann_degrees(s: SparkSession, d: str) -> DataFrame:
    """Links of a built graph that are too many, to the node itself, or to none of the table; there are none of these."""
    nodes = graph.build(_base(s, d), degree=24, size=50)
    links = nodes.select("id", F.size("nbrs").alias("n"), F.explode("nbrs").alias("to"))
    known = nodes.select(F.col("id").alias("known"))
    bad = links.join(known, F.col("to") == F.col("known"), "left").agg(F.count_if((F.col("n") > 24) | (F.col("to") == F.col("id")) | F.col("known").isNull()).alias("n_bad"))
    return nodes.agg(F.count("*").alias("n_nodes")).join(bad)


def fbin_stripes(s: SparkSession, d: str) -> DataFrame:
    """Sizes of the vector files that the table would be written as, striped over four devices."""
    return vector_blobs(_base(s, d), 4).select("file", F.octet_length("content").alias("n_bytes"))


def fbin_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Vectors written to four files' bytes and read again: a file's rows are in id order."""
    rows = decode_vectors(vector_blobs(_base(s, d), 4))
    return rows.select("file", "id", F.get("v", F.lit(0)).cast("double").alias("first"), F.get("v", F.lit(DIMS - 1)).cast("double").alias("last"))


def search_stats(s: SparkSession, d: str) -> DataFrame:
    """One row of a search by codes: queries, mean and least recall, and queries a second if it took two."""
    return knn.search_report(_by_codes(s, d), knn_exact_l2(s, d), K, 2.0)


QUERIES = {f.__name__: f for f in (
    knn_exact_l2, knn_graph, vec_mean, vec_medoid, vec_medoid_total, vec_sample, pq_encode, pq_lloyd_step, pq_adc, pq_topk, recall_at_k, graph_bfs_levels, graph_reorder,
    entry_points, robust_prune, robust_prune_degrees, pq_train, vamana_search, vamana_recall, vamana_enough, ann_search_recall, ann_artefacts, ann_degrees, fbin_stripes, fbin_roundtrip, search_stats,
)}


_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
_B = "b AS (SELECT vec_id AS id, embedding AS v FROM embeddings)"
_TOP = f"d AS (SELECT q.id AS qid, b.id, {_L2.format(a='q.v', b='b.v')} AS dist FROM b q JOIN b ON q.id % {ASK_EVERY} = 0), top AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INT AS rank, id, dist FROM d)"
_NEAR = f"g AS (SELECT * FROM (SELECT q.id AS qid, b.id, {_L2.format(a='q.v', b='b.v')} AS dist FROM b q JOIN b ON q.id <> b.id)), gr AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INT AS rank, id, dist FROM g), kg AS (SELECT * FROM gr WHERE rank <= 4)"
_MEAN = "x AS (SELECT id, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) - 1 AS dim FROM b), mean AS (SELECT dim::INT AS dim, round(avg(x), 9) AS mean FROM x GROUP BY dim), c AS (SELECT list(mean ORDER BY dim) AS c FROM mean)"
_AT = chunk_offsets(DIMS, CHUNKS)
_W = _AT[1]
_PARTS = f"""p AS (SELECT id, j AS chunk, list_transform(list_zip(v[j * {_W} + 1 : j * {_W} + {_W}], c[j * {_W} + 1 : j * {_W} + {_W}]), lambda p: p[1]::DOUBLE - p[2]) AS x FROM b, c, range({CHUNKS}) r(j)),
book AS (SELECT chunk, id::INT AS code, x AS w FROM p WHERE id < {CODES})"""
_ENC = f"enc AS (SELECT id, chunk::INT AS chunk, code FROM (SELECT p.id, p.chunk, code, row_number() OVER (PARTITION BY p.id, p.chunk ORDER BY {_L2.format(a='x', b='w')}, code) AS n FROM p JOIN book USING (chunk)) WHERE n = 1)"
_ADC = f"t AS (SELECT p.id AS qid, p.chunk::INT AS chunk, code, {_L2.format(a='x', b='w')} AS d FROM p JOIN book USING (chunk) WHERE p.id % {ASK_EVERY} = 0)"
_CODED = f"cd AS (SELECT qid, id, round(sum(d), 9) AS dist FROM enc JOIN t USING (chunk, code) GROUP BY qid, id), ct AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INT AS rank, id FROM cd)"
_LEVELS = "RECURSIVE {b}, {near}, lv AS (SELECT 0::BIGINT AS id, 0 AS level UNION SELECT kg.id, level + 1 FROM lv JOIN kg ON kg.qid = lv.id WHERE level < 64), first AS (SELECT id, min(level) AS level FROM lv GROUP BY id)".format(b=_B, near=_NEAR.replace("kg AS (", "kg AS MATERIALIZED ("))

_POINTS = ", ".join(
    f"p{i} AS (SELECT id, v FROM near ORDER BY least({', '.join(_L2.format(a='near.v', b=f'(SELECT v FROM p{j})') for j in range(i))}) DESC, level, id LIMIT 1)" for i in range(1, 5)
)
_PICKED = " UNION ALL ".join(f"SELECT {i}::INT AS nth, id FROM p{i}" for i in range(5))

SQL = {
    "knn_exact_l2": f"WITH {_B}, {_TOP} SELECT qid, rank, id, dist FROM top WHERE rank <= {K}",
    "knn_graph": f"WITH {_B}, {_NEAR} SELECT qid, rank, id, dist FROM kg",
    "vec_mean": f"WITH {_B}, {_MEAN} SELECT dim, mean FROM mean",
    "vec_medoid": f"WITH {_B}, {_MEAN} SELECT id, round({_L2.format(a='v', b='c')}, 6) AS dist FROM b, c ORDER BY {_L2.format(a='v', b='c')}, id LIMIT 1",
    "vec_medoid_total": f"WITH {_B}, t AS (SELECT q.id, round(sum({_L2.format(a='q.v', b='b.v')}), 6) AS total FROM b q, b GROUP BY q.id) SELECT id, total FROM t ORDER BY total, id LIMIT 1",
    "vec_sample": "SELECT vec_id AS id FROM embeddings ORDER BY md5(vec_id || ':42'), vec_id LIMIT 100",
    "pq_encode": f"WITH {_B}, {_MEAN}, {_PARTS}, {_ENC} SELECT id, chunk, code FROM enc",
    "pq_lloyd_step": f"WITH {_B}, {_MEAN}, {_PARTS}, {_ENC}, o AS (SELECT enc.chunk, code, unnest(x) AS v, generate_subscripts(x, 1)::INT - 1 AS dim FROM p JOIN enc ON p.id = enc.id AND p.chunk = enc.chunk), mv AS (SELECT chunk, code, dim, round(avg(v), 6) AS mean FROM o GROUP BY ALL), k AS (SELECT chunk::INT AS chunk, code, unnest(w) AS old, generate_subscripts(w, 1)::INT - 1 AS dim FROM book) SELECT k.chunk, k.code, k.dim, coalesce(mean, round(old, 6)) AS mean FROM k LEFT JOIN mv USING (chunk, code, dim)",
    "pq_adc": f"WITH {_B}, {_MEAN}, {_PARTS}, {_ADC} SELECT qid, chunk, code, round(d, 9) AS d FROM t",
    "pq_topk": f"WITH {_B}, {_MEAN}, {_PARTS}, {_ENC}, {_ADC}, {_CODED} SELECT qid, rank, id FROM ct WHERE rank <= {K}",
    "recall_at_k": f"WITH {_B}, {_MEAN}, {_PARTS}, {_ENC}, {_ADC}, {_CODED}, {_TOP} SELECT top.qid, count(ct.id) / {K} AS recall FROM top LEFT JOIN ct ON ct.qid = top.qid AND ct.id = top.id AND ct.rank <= {K} WHERE top.rank <= {K} GROUP BY top.qid",
    "search_stats": f"WITH {_B}, {_MEAN}, {_PARTS}, {_ENC}, {_ADC}, {_CODED}, {_TOP}, r AS (SELECT top.qid, count(ct.id) / {K} AS recall FROM top LEFT JOIN ct ON ct.qid = top.qid AND ct.id = top.id AND ct.rank <= {K} WHERE top.rank <= {K} GROUP BY top.qid) SELECT count(*) AS n_queries, round(avg(recall), 9) AS mean_recall, min(recall) AS least_recall, count(*) / 2.0::DOUBLE AS per_second FROM r",
    "fbin_roundtrip": f"SELECT vec_id % 4 AS file, vec_id // 4 AS id, embedding[1]::DOUBLE AS first, embedding[{DIMS}]::DOUBLE AS last FROM embeddings",
    "graph_bfs_levels": f"WITH {_LEVELS} SELECT id, level FROM first",
    "graph_reorder": f"WITH {_LEVELS} SELECT id, row_number() OVER (ORDER BY level NULLS LAST, id) - 1 AS place FROM (SELECT id FROM b) LEFT JOIN first USING (id)",
    "pq_train": f"SELECT r.range::INT AS chunk, {CODES}::BIGINT AS n_codes FROM range({CHUNKS}) r",
    "vamana_enough": f"SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % {ASK_EVERY} = 0",
    "ann_search_recall": f"SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % {ASK_EVERY} = 0",
    "ann_artefacts": f"SELECT unnest(['chunks', 'codes', 'nodes', 'medoid', 'entries']) AS name, unnest([{CHUNKS}, n, n, 1, 6]) AS n FROM (SELECT count(*) AS n FROM embeddings)",
    "ann_degrees": "SELECT count(*) AS n_nodes, 0::BIGINT AS n_bad FROM embeddings",
    "entry_points": f"""WITH {_LEVELS}, near AS (SELECT b.id, b.v, level FROM first JOIN b USING (id) ORDER BY level, id LIMIT 50),
  p0 AS (SELECT id, v FROM near ORDER BY level, id LIMIT 1), {_POINTS} SELECT nth, id FROM ({_PICKED})""",
    "robust_prune_degrees": f"""WITH {_B}, {_NEAR.replace('rank <= 4', 'rank <= 40')} SELECT qid AS id, count(*)::INT AS n_offered, 12 AS n_kept FROM kg GROUP BY qid""",
    "fbin_stripes": f"SELECT vec_id % 4 AS file, (8 + count(*) * {DIMS} * 4)::INT AS n_bytes FROM embeddings GROUP BY 1",
}
