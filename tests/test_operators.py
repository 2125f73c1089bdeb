"""Small hand-made cases, golden rows, and a dictionary model of the log."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.functions.hashing import crc32c_of, fnv1a32, fnv1a64_of, splitmix64
from siltstone.operators import cache, fold, graph, knn, log, pq, reads, recovery, tiles
from siltstone.sources import binary, resp

LOG = "key string, seq long, lsn long, gen long, op string, value string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def golden(spark):
    """Active and sealed generations: newest version of each key wins, tombstones included."""
    put = [("b", 10, "1010"), ("a", 9, "2009"), ("b", 8, "2008"), ("c", 7, "3007"), ("d", 6, "3006")]
    data = [(k, v, v, v // 4, "PUT", x) for k, v, x in put] + [("c", 11, 11, 2, "DEL", None)]
    return spark.createDataFrame(data, LOG)


def test_scan_keeps_one_winner(golden):
    s = reads.Snapshot(golden, 100)
    assert rows(s.scan("a", "z", keep_tombstones=True), "key", "lsn", "op") == [("a", 9, "PUT"), ("b", 10, "PUT"), ("c", 11, "DEL"), ("d", 6, "PUT")]
    assert rows(s.scan("b", "d"), "key") == [("b",)]
    assert s.scan("d", "b").isEmpty()


def test_snapshot_visibility(spark):
    c = spark.createDataFrame([("x", 10, 10, 0, "PUT", "old"), ("x", 30, 30, 1, "PUT", "new")], LOG)
    for lsn, want in ((9, []), (20, [(10,)]), (30, [(30,)])):
        assert rows(reads.Snapshot(c, lsn).get("x"), "lsn") == want
    with pytest.raises(ValueError):
        reads.Snapshot(c, 5, base=c.limit(0), base_frontier=10).rows()


def test_delete_hides_older_values(spark):
    c = spark.createDataFrame([("k", 1, 1, 0, "PUT", "v"), ("k", 2, 2, 0, "DEL", None)], LOG)
    assert reads.Snapshot(c, 2).get("k").isEmpty()
    assert rows(reads.Snapshot(c, 1).get("k"), "value") == [("v",)]


def test_pages_end(golden):
    s = reads.Snapshot(golden, 100)
    assert [r.key for r in s.page(None, 2).collect()] == ["a", "b"]
    assert [r.key for r in s.page("b", 2).collect()] == ["d"]
    assert s.page("d", 2).isEmpty()


def test_canonical_batch_keeps_last(spark):
    ops = spark.createDataFrame([(1, 0, "a", "PUT"), (1, 1, "b", "PUT"), (1, 2, "a", "DEL"), (2, 0, "a", "PUT")], "batch_id int, pos int, key string, op string")
    assert rows(log.canonicalize(ops), "batch_id", "pos", "key", "op") == [(1, 1, "b", "PUT"), (1, 2, "a", "DEL"), (2, 0, "a", "PUT")]


@pytest.mark.parametrize(("lsn", "want"), [([], 0), ([1], 1), ([1, 3], 1), ([1, 3, 2], 3), ([2, 3], 0), ([1, 2, 2, 3], 3)])
def test_durable_prefix(spark, lsn, want):
    df = spark.createDataFrame([(x,) for x in lsn], "lsn long")
    assert log.durable_prefix(df).first()[0] == want


def test_dense_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (5, 90, 7, 300, 6)], "n long")
    assert rows(log.dense_numbers(df, "n", "nth", 50), "n", "nth") == [(5, 1), (6, 2), (7, 3), (90, 4), (300, 5)]


def test_merge_drops_old_tombstones_only(spark):
    kv = "key string, lsn long, op string, value string"
    base = spark.createDataFrame([("a", 1, "PUT", "1"), ("b", 2, "PUT", "2"), ("c", 3, "PUT", "3")], kv)
    delta = spark.createDataFrame([("b", 5, "DEL", None), ("c", 9, "DEL", None), ("d", 6, "PUT", "4")], kv)
    assert rows(fold.leaf_merge(base, delta, 5), "key", "lsn", "op") == [("a", 1, "PUT"), ("c", 9, "DEL"), ("d", 6, "PUT")]


WAL = "segment int, pos int, lsn long, entry_count long, op string, key string, value string, ok boolean"


def test_incomplete_and_torn(spark):
    wal = spark.createDataFrame([(0, 0, 1, 2, "PUT", "a", "x", True), (0, 1, 1, 2, "PUT", "b", "y", True), (0, 2, 2, 2, "PUT", "a", "z", True), (1, 0, 3, 1, "PUT", "c", "w", False), (1, 1, 4, 1, "DEL", "b", None, True)], WAL)
    assert rows(recovery.replay(recovery.untorn(wal)), "key", "lsn", "value") == [("a", 1, "x"), ("b", 1, "y")]


def test_broken_logs_raise(spark):
    twice = spark.createDataFrame([(0, 0, 1, 2, "PUT", "a", "x", True), (0, 1, 1, 2, "PUT", "a", "y", True)], WAL)
    with pytest.raises(PySparkException):
        recovery.complete(twice).collect()
    kv = "key string, lsn long, op string, value string"
    with pytest.raises(PySparkException):
        recovery.merge(spark.createDataFrame([("a", 1, "PUT", "x")], kv), spark.createDataFrame([("a", 1, "DEL", None)], kv)).collect()


@pytest.mark.parametrize("seed", range(3))
def test_log_against_dictionary(spark, seed):
    r = random.Random(seed)
    data = [(f"k{r.randrange(12)}", i, i // 5 + 1, i // 20, r.choice(("PUT", "PUT", "DEL")), f"v{i}") for i in range(120)]
    c = spark.createDataFrame(data, LOG)
    for lsn in (3, 11, 24):
        state = {}
        for k, _, n, _, op, v in data:
            if n <= lsn:
                state.pop(k, None) if op == "DEL" else state.__setitem__(k, v)
        assert rows(reads.Snapshot(c, lsn).scan(), "key", "value") == sorted(state.items())


def test_cache_time_to_live(spark):
    cmds = [
        (1, 0, ["SET", "a", "1", "EX", "1"]), (2, 500, ["get", "a"]), (3, 1000, ["GET", "a"]), (4, 1100, ["DEL", "a"]), (5, 1200, ["SET", "a", "2", "px", "-5"]),
        (6, 9999, ["GET", "a"]), (7, 9999, ["DEL", "a", "zz", "a"]), (8, 9999, ["SET", "b"]), (9, 9999, ["NOPE"]), (10, 9999, []), (11, 9999, ["command"]), (12, 9999, ["SET", "b", "3", "EX"]),
    ]
    df = cache.parse(spark.createDataFrame(cmds, "seq long, ts_ms long, argv array<string>"))
    got = [(r.kind, r.value) for r in cache.respond(df).orderBy("seq").collect()]
    assert got[:7] == [("OK", None), ("BULK", "1"), ("NIL", None), ("INTEGER", "0"), ("OK", None), ("BULK", "2"), ("INTEGER", "1")]
    assert [k for k, _ in got[7:]] == ["ERR", "ERR", "ERR", "EMPTY_ARRAY", "OK"]
    assert rows(cache.final_state(df), "key", "value", "expire_at", "version") == [("b", "3", -1, 0)]


def test_cache_tiers(spark):
    df = spark.createDataFrame([(n,) for n in (0, 16, 17, 64, 4096, 4097, 16384)], "n long").select("n", cache.tier(F.col("n")), cache.slot(F.col("n")), cache.pages(F.col("n")))
    assert [tuple(r)[1:] for r in df.collect()] == [("inline", None, 0), ("inline", None, 1), ("slab", 64, 1), ("slab", 64, 1), ("slab", 4096, 1), ("large", None, 2), ("large", None, 4)]


def test_resp_frames():
    data = b"*2\r\n$3\r\nGET\r\n$1\r\na\r\nPING now\r\n*1\r\n$4\r\nPI"
    got, used = resp.requests(data)
    assert got == [[b"GET", b"a"], [b"PING", b"now"]]
    assert data[used:] == b"*1\r\n$4\r\nPI"


def test_batch_codec():
    ops = [("PUT", "a", "1"), ("DEL", "b", None), ("PUT", "", "")]
    data = binary.encode_batch(ops)
    assert [r[1:] for r in binary.decode_batch(data)] == ops
    for bad in (data[:-1], data + b"x", data[:4] + b"\x09" + data[5:], b"\x01\x00\x00\x00\x02\x01\x00\x00\x00\x01\x00\x00\x00av"):
        with pytest.raises(ValueError):
            binary.decode_batch(bad)


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "x.fbin").write_bytes(binary.vector_file(x))
    got = binary.read_vectors(spark, str(tmp_path / "x.fbin")).orderBy("id").collect()
    assert [r.v for r in got] == x.tolist()
    (tmp_path / "y.fbin").write_bytes(binary.vector_file(x)[:-1])
    with pytest.raises(PySparkException):
        binary.read_vectors(spark, str(tmp_path / "y.fbin")).collect()


def test_known_hashes(spark):
    assert crc32c_of(b"123456789") == 0xE3069283
    assert fnv1a64_of(b"foobar") == 9625390261332436968
    assert int(splitmix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF
    got = spark.createDataFrame([("key",), ("",)], "k string").select(fnv1a32(F.col("k"))).collect()
    assert [r[0] for r in got] == [1746258028, 2166136261]


def test_index_files_and_search(spark, tmp_path):
    r = np.random.default_rng(0)
    base = spark.createDataFrame([(i, r.uniform(-1, 1, 8).tolist()) for i in range(200)], "id long, v array<double>")
    index = graph.build(base, degree=12, size=30, shard=80)
    binary.save_index(index, {"degree": 12}, str(tmp_path / "ix"), 3)
    index, meta = binary.load_index(spark, str(tmp_path / "ix"))
    assert meta == {"degree": "12"}
    asked = base.filter("id < 10")
    truth = knn.nearest(base, asked, 10)
    found = graph.search(index, asked, 10, size=40, probes=2)
    assert knn.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9
    assert index.filter("size(nbrs) > 12").isEmpty()


def test_robust_prune_drops_copies():
    x = np.array([[0.0], [1.0], [1.0], [3.0], [-2.0]])
    assert graph.robust_prune(x, 0, np.arange(5), 2, 1.2) == [1, 4]  # a copy is out of the rounds
    assert graph.robust_prune(x, 0, np.arange(5), 4, 1.2) == [1, 4, 2, 3]  # and back when the degree is filled
    assert graph.robust_prune(x, 0, np.arange(5), 4, 1.0) == [1, 4]  # which needs a factor above 1


def test_committed_batches(spark, tmp_path):
    from siltstone.streaming.upsert import commit_batches, committed

    data = [(f"k{i}", i, i + 1, 0, "PUT", "v") for i in range(10) if i != 7]
    spark.createDataFrame(data, LOG).write.parquet(str(tmp_path / "in"))
    commit_batches(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    assert committed(spark, str(tmp_path / "out")).agg(F.max("lsn")).first()[0] == 7


def test_vector_queries_cover_the_table(spark, sf_dir):
    """Pruning, entry points and graph search against brute force over all vectors."""
    from siltstone.plans.vector_queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")
    pruned = {r.id: r.nbrs for r in QUERIES["robust_prune"](spark, sf_dir).collect()}
    assert pruned == {int(ids[i]): ids[graph.robust_prune(x, i, np.sort(near[i, :40]), 12, 1.2)].tolist() for i in range(len(ids))}
    level, front = {0: 0}, [0]
    while front:
        nxt = sorted({int(j) for i in front for j in near[i, :4]} - set(level))
        level |= {j: level[front[0]] + 1 for j in nxt}
        front = nxt
    order = sorted(level, key=lambda i: (level[i], i))[:50]
    own, far = [order[0]], d[order[0]].copy()
    far[order[0]] = 0
    while len(own) < 5:
        own.append(max(order, key=lambda i: (far[i], -order.index(i))))
        far = np.minimum(far, np.where(np.arange(len(ids)) == own[-1], 0, d[own[-1]]))
    assert [r.id for r in QUERIES["entry_points"](spark, sf_dir).orderBy("nth").collect()] == ids[own].tolist()
    recall = {r.qid: r.recall for r in QUERIES["vamana_recall"](spark, sf_dir).collect()}
    assert set(recall) == {i for i in ids.tolist() if i % 20 == 0} and np.mean(list(recall.values())) >= 0.9


def test_places_of_few_true_entries():
    """As numpy finds them, whether or not the entries come in eights."""
    r = np.random.default_rng(5)
    for shape in ((3, 7), (5, 16), (1, 8), (4, 2), (6, 24)):
        for share in (0.0, 0.1, 1.0):
            held = r.random(shape) < share
            assert tiles.places(held).tolist() == np.flatnonzero(held).tolist()


def test_rows_are_sent_to_few_blocks():
    """A row travels once for each block of queries, and there are cells enough for all cores."""
    for n in (1, 5_130, 102_564, 1_000_000):
        blocks, parts = tiles.layout(n, 8)
        assert blocks * parts >= 16 and n <= blocks * tiles.BLOCK
    assert tiles.layout(102_564, 8)[0] <= 8


def test_codes_of_many_vectors_at_once(spark):
    """Vectorized codes are those of the expressions: ties, nulls, other widths, NaN and chunks without a book."""
    inf, nan = float("inf"), float("nan")
    xs = [[0.0, 0.0], [1.0, 1.0], [0.5, 0.5], [3.0, -1.0], [nan, 0.0], [inf, 0.0], [-inf, inf], [None, 1.0], [1.0], [1.0, 2.0, 3.0], [], None]
    parts = spark.createDataFrame([(i, c, x) for i, x in enumerate(xs) for c in (0, 1, 2)], "id long, chunk int, x array<double>")
    book = [(0, 3, [1.0, 1.0]), (0, 1, [0.0, 0.0]), (0, 2, [0.0, 0.0]), (1, 0, [nan, 1.0]), (1, 5, [inf, 2.0]), (1, 4, [9.0, 9.0])]
    book = spark.createDataFrame(book, "chunk int, code int, w array<double>")
    got = pq.encode(parts, book)
    want = pq._encode_plainly(parts, book)
    assert "MapInArrow" in got._jdf.queryExecution().toString() and got.dtypes == want.dtypes
    assert rows(got, "id", "chunk", "code") == rows(want, "id", "chunk", "code") and got.count() == 24
    odd = book.unionByName(spark.createDataFrame([(1, 6, [1.0])], book.schema))
    assert rows(pq.encode(parts, odd), "id", "chunk", "code") == rows(pq._encode_plainly(parts, odd), "id", "chunk", "code")


def test_nearest_in_single_precision():
    """Neighbours are exact, ties too, by products in single precision, or in double where single tells too little."""
    from siltstone.operators.knn import _Nearest

    r = np.random.default_rng(1)
    ids, x = r.permutation(3000), r.normal(size=(3000, 16)).astype(np.float32).astype(np.float64)
    ids[2990:] = ids[:10]
    coarse = np.round(x * 2) / 2
    coarse[100:400] = coarse[:300]
    for rows, short in ((x, True), (coarse, True), (x + 1e5, False), (x * 3e16, False), (x * 1e100, False), (x * 1e-25, False), (x * 0, False)):
        for k, skip in ((4, True), (40, False)):
            found = _Nearest(ids[:300], rows[:300], k, skip)
            for a, b in ((0, 3), (3, 1500), (1500, 3000)):
                found.add(ids[a:b], rows[a:b])
            found.merge()
            row, ident, dist = found.held
            for i in range(300):
                d = np.zeros(3000)
                for c in rows.T:
                    d += (c[i] - c) ** 2
                other = ids != ids[i] if skip else np.ones(3000, bool)
                best = np.lexsort((ids[other], d[other]))[:k]
                assert ident[row == i].tolist() == ids[other][best].tolist() and dist[row == i].tolist() == d[other][best].tolist()
            assert (found.short is not None) == short


def test_levels_in_one_task_and_by_rounds(spark, monkeypatch):
    """Both ways give the same levels: repeated and null ends, cycles, several starts, a bound on levels; few edges need no table a level."""
    from siltstone.operators import graph

    rows = [(i, j) for i in range(30) for j in (i + 1, i * 7 % 30, i)] + [(5, 900), (5, 900), (None, 3), (4, None), (1000, 0)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    for first, most in (([0], 64), ([0], 2), ([0, 29, 29, 17], 64), ([4000], 64), ([], 64)):
        start = spark.createDataFrame([(i,) for i in first], "id long")
        level, front = dict.fromkeys(first, 0), set(first)
        for nth in range(1, most + 1):
            front = {b for a, b in rows if a in front and b is not None} - set(level)
            level |= dict.fromkeys(front, nth)
        for walked in (0, len(rows) + 4):
            got = graph.bfs_levels(edges, start, most, walked)
            assert sorted(map(tuple, got.collect())) == sorted(level.items()) and got.columns == ["id", "level"]
    monkeypatch.setattr(graph, "written", None)
    assert graph.bfs_levels(edges, spark.range(1)).count() == 32


def test_store_conflicts_and_windows(spark, tmp_path):
    """Two writers of one version, a full window, a writer that fails, and opening what is not there."""
    from siltstone.operators.store import BackPressure, Conflict, Store

    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        Store(spark, path).manifest()
    store = Store.create(spark, path, window=3)
    with pytest.raises(FileExistsError):
        Store.create(spark, path)
    ops = spark.createDataFrame([(b, p, "PUT", f"k{p}", f"v{b}") for b in range(2) for p in (0, 1, 1)], "batch_id long, pos long, op string, key string, value string")
    assert store.apply(ops.limit(0)) is None and store.stats()["next_lsn"] == 1
    before = store.manifest()
    assert store.stage(ops) == (1, 2)
    with pytest.raises(BackPressure):
        store.stage(ops)
    with pytest.raises(Conflict):
        store._install(before, next_lsn=9)
    assert store.stats()["next_lsn"] == 3 and store.snapshot().scan().isEmpty() and store.seal() == store.manifest()
    store.resolve((1, 2))
    assert sorted((r.key, r.lsn, r.value) for r in store.snapshot().scan().collect()) == [("k0", 2, "v1"), ("k1", 2, "v1")]
    with pytest.raises(ZeroDivisionError), store.batch() as scope:
        scope.put(spark.createDataFrame([("k9", "x")], "key string, value string"))
        1 / 0  # noqa: B018
    assert store.put(spark.createDataFrame([("k2", "w")], "key string, value string")) == (3, 3)
    assert store.delete(spark.createDataFrame([("k0",)], "key string")) == (4, 4)
    assert {r.key for r in store.snapshot().scan().collect()} == {"k1", "k2"} and store.verify().isEmpty()
    store.seal()
    store.flush()
    with pytest.raises(ValueError):
        store.snapshot(lsn=1).rows()
    assert store.flush() == store.manifest() and {r.key for r in store.snapshot().scan().collect()} == {"k1", "k2"}


def test_index_checks(spark, tmp_path):
    """An index that lacks an artefact, or whose codebook does not fit, is refused; a finished stage is not run again."""
    from siltstone.operators import ann

    r = np.random.default_rng(0)
    base = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(60)], "id long, v array<double>")
    path = f"file://{tmp_path}/i"
    options = ann.Options(8, 4, 6, degree=6, size=12, entries=3, devices=2)
    assert ann.build(base, path, options) == list(ann.STAGES) and ann.build(base, path, options) == []
    index = ann.load(spark, path)
    assert index.options == options and index.entries.count() == 3 and index.entries.filter(F.col("id") == index.medoid).count() == 1
    hits = index.search(base.filter("id < 3"), k=1, size=20).collect()
    assert {(h.qid, h.id) for h in hits} == {(i, i) for i in range(3)}
    with pytest.raises(ValueError):
        ann.check_codebook(spark.read.parquet(f"{path}/codebook").filter("code <> 2"), options)
    ann.Files(spark, path).delete("entries")
    with pytest.raises(FileNotFoundError):
        ann.load(spark, path)
    assert ann.build(base, path, options) == ["entries"]


def test_frames(spark):
    from siltstone.operators import frames

    rows = frames.frame(spark.createDataFrame([(i, b"body%d" % i, 7) for i in range(6)], "pos int, body binary, gen long"), "body", "gen").withColumn("segment", F.lit(1))
    torn = rows.withColumn("frame", F.when(F.col("pos") == 4, F.expr("substr(frame, 1, 10)")).otherwise(F.col("frame")))
    assert {r.pos for r in frames.trusted(torn, "frame", F.lit(7), "segment", "pos").collect()} == {0, 1, 2, 3}
    assert [r.s for r in torn.filter("pos = 4").select(frames.status(F.col("frame"), F.lit(7)).alias("s")).collect()] == ["truncated"]


def test_nearest_of_odd_rows(spark, monkeypatch):
    """Copies, ties, vectors far from the origin, repeated ids, and rows that are null or no numbers: as by all pairs, nulls last."""
    monkeypatch.setattr(tiles, "BLOCK", 16)
    monkeypatch.setattr(tiles, "TILE", 64)
    r = np.random.default_rng(4)
    v = [*r.integers(-2, 3, (80, 5)).astype(float).tolist(), *(1e6 + r.random((40, 5))).tolist()]
    data = [(i if i != 7 else 6, x) for i, x in enumerate(v)] + [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, [1.0])]
    base = spark.createDataFrame(data, "id long, v array<double>")
    asked = base.filter("id % 3 = 0 OR id = 201")

    def dist(a, b):
        if a is None or b is None or len(a) != len(b) or None in a + b:
            return None
        d = 0.0
        for x, y in zip(a, b, strict=True):
            d += (x - y) * (x - y)
        return d

    order = lambda x: (x[0] is None, x[0] != x[0], x[0] if x[0] is not None and x[0] == x[0] else 0.0, x[1])
    for skip in (False, True):
        want = []
        for q in {q for q, _ in data if q % 3 == 0 or q == 201}:
            found = sorted(((dist(b, x), i) for a, b in data if a == q for i, x in data if not skip or i != q), key=order)
            want += [(q, n, i, repr(d)) for n, (d, i) in enumerate(found[:6], 1)]
        got = [(x.qid, x.rank, x.id, repr(x.dist)) for x in knn.nearest(base, asked, 6, skip).collect()]
        assert sorted(got) == sorted(want)


def test_nearest_by_table(spark, monkeypatch):
    """As by all sums: many equal sums, a code that is missing, a query without a number, rows that lack a chunk."""
    monkeypatch.setattr(tiles, "BLOCK", 8)
    monkeypatch.setattr(tiles, "TILE", 64)
    r = np.random.default_rng(2)
    table = [(q, c, x, float(r.integers(0, 3)) / 3 if (q, c, x) != (5, 1, 1) else None) for q in range(20) for c in range(3) for x in range(4) if (q, c, x) != (4, 0, 0)]
    codes = [(i, c, int(r.integers(0, 4))) for i in range(150) for c in range(3) if (i, c) != (30, 2)]
    table, codes = spark.createDataFrame(table, "qid long, chunk int, code int, d double"), spark.createDataFrame(codes, "id long, chunk int, code int")
    want = {}
    for x in pq.by_table(table, codes).collect():
        want.setdefault(x.qid, []).append((x.dist is None, x.dist, x.id))
    want = sorted((q, n, i) for q, own in want.items() for n, (_, _, i) in enumerate(sorted(own)[:7], 1))
    found = pq.nearest_by_table(table, codes, 7)
    assert sorted((x.qid, x.rank, x.id) for x in found.collect()) == want


def test_total_medoid(spark):
    """Without pairs of regular vectors; null vectors come last."""
    r = np.random.default_rng(9)
    x = 1000 + r.random((60, 4))
    data = [(i, v) for i, v in enumerate(x.tolist())] + [(100, None), (61, x[5].tolist())]
    base = spark.createDataFrame(data, "id long, v array<double>")
    every = np.vstack([x, x[5]])
    total = ((every[:, None] - every[None]) ** 2).sum((1, 2))
    best = min((round(t, 6), i if i < 60 else 61) for i, t in enumerate(total))
    found = knn.total_medoid(base)
    assert [(r.total, r.id) for r in found.collect()] == [best]
    far = spark.createDataFrame([*data, (300, [float("inf")] * 4)], "id long, v array<double>")
    assert knn.total_medoid(far).first().id is not None


def test_graph_of_a_large_shard(spark):
    """Nodes put in by batches: pruned as one by one, links within the degree, and a few thousand vectors in seconds."""
    import time

    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 32))
    nodes, cand = np.arange(50), np.sort(np.array([r.choice(4000, 40, replace=False) for _ in range(50)]), 1)
    y = x[cand]
    for alpha in (1.0, 1.2):
        kept = graph.prune_rows(y, ((y - x[nodes, None]) ** 2).sum(-1), cand, cand != nodes[:, None], 12, alpha)
        assert [c[k[k >= 0]].tolist() for c, k in zip(cand, kept, strict=True)] == [graph.robust_prune(x, i, cand[i], 12, alpha) for i in nodes]
    began = time.time()
    links, start = graph.vamana(x, 24, 50, 1.2)
    assert time.time() - began < 40
    assert all(len(own) <= 24 and len(set(own.tolist())) == len(own) and i not in own for i, own in enumerate(links))
    q = x[::40]
    near = ((q[:, None] - x) ** 2).sum(2)
    table = np.full((4000, 24), -1)
    for i, own in enumerate(links):
        table[i, : len(own)] = own
    row, node, _ = graph.beam(x, table, near.T, q, [start], 10, 50, 4, 1)
    true = np.argsort(near, axis=1)[:, :10]
    assert np.mean([len({*node[row == i].tolist()} & {*true[i].tolist()}) / 10 for i in range(len(q))]) >= 0.9


def test_table_sums_by_products(monkeypatch):
    """Sums of all pairs are matrix products, without a lookup a pair and chunk; what they keep is as by sums in chunk order."""
    r = np.random.default_rng(6)
    table, slots = r.integers(0, 4, (30, 24)) / 3, r.integers(0, 4, (900, 6)) + 4 * np.arange(6)
    dist = np.zeros((30, 900))
    for slot in slots.T:
        dist += table[:, slot]
    want = {(q, i) for q in range(30) for i in np.lexsort((np.arange(900), np.round(dist[q], 9)))[:5]}
    monkeypatch.setattr(pq.np, "take", None)
    best = pq._Lookups(np.arange(30), table, 5, 9)
    for a in range(0, 900, 100):
        best.add(np.arange(a, a + 100), slots[a : a + 100].astype(float))
    qid, ident, d = best.rows()
    assert want <= set(zip(qid.tolist(), ident.tolist(), strict=True)) and all(d == dist[qid, ident])


def test_prune_table_of_many_nodes(spark):
    """As one by one, in a few tasks' time: lists of many lengths, none, and groups that go on over batches."""
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 6)).round(1)
    x[7] = x[9]
    cands = {i: sorted(int(c) for c in r.choice(300, int(r.integers(0, 30)), replace=False) if c != i) for i in range(0, 300, 2)}
    base = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    table = spark.createDataFrame(list(cands.items()), "id long, cands array<long>")
    pruned = graph.prune_table(base, table, 5, 1.2)
    assert "FlatMapGroupsInPandas" not in pruned._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = {row.id: row.nbrs for row in pruned.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: graph.robust_prune(x, i, np.array(c), 5, 1.2) for i, c in cands.items() if c}
