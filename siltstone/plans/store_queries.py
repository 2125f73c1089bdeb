"""Queries over the versioned table, its rounds, and the log's frames, with their SQL.

Each writes the change log into a table of its own, in three runs of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import frames, reads
from siltstone.operators.store import Store
from siltstone.plans.kv_queries import LOG, WON, _key
from siltstone.sources.scratch import fresh_dir
from siltstone.sources.tables import change_log


def _runs(s: SparkSession, d: str) -> list[DataFrame]:
    """The log's batches in three runs of equal length."""
    c = change_log(s, d)
    n = c.agg(F.max("batch_id") + 1).first()[0]
    part = F.expr(f"batch_id * 3 DIV {n}")
    return [c.filter(part == i) for i in range(3)]


def _new(s: SparkSession) -> Store:
    return Store.create(s, fresh_dir(s, "store"))


def _flushed(s: SparkSession, d: str) -> Store:
    """The first two runs flushed, the third in the log."""
    store = _new(s)
    a, b, c = _runs(s, d)
    store.apply(a)
    store.seal()
    store.apply(b)
    store.seal()
    store.flush()
    store.reclaim()
    store.apply(c)
    return store


def _latest(store: Store) -> DataFrame:
    return reads.live(reads.winners(store.snapshot().rows()))


def kv_store_latest(s: SparkSession, d: str) -> DataFrame:
    """Live rows over base and log."""
    return _latest(_flushed(s, d))


def kv_store_scan(s: SparkSession, d: str) -> DataFrame:
    """[begin, end) over base and log; both are sorted by key, so the bounds reach their files' statistics."""
    return _flushed(s, d).snapshot().scan(_key(20), _key(60))


def kv_store_flush_round(s: SparkSession, d: str) -> DataFrame:
    """The base that the flush round installed."""
    store = _flushed(s, d)
    return store.base(store.manifest())


def kv_store_seal_round(s: SparkSession, d: str) -> DataFrame:
    """Generations after each run is sealed: a batch is wholly in one."""
    store = _new(s)
    for run in _runs(s, d):
        store.apply(run)
        store.seal()
    now = store.manifest()
    return store.rows(now).groupBy("gen").agg(F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.count("*").alias("n_rows"))


def kv_store_batch_scope(s: SparkSession, d: str) -> DataFrame:
    """What a scope reads that began after the first run, while the second is applied, and its own delete after all."""
    store = _new(s)
    a, b, _ = _runs(s, d)
    store.apply(a)
    with store.batch() as scope:
        store.apply(b)
        seen = scope.scan().withColumn("at", F.lit("scope"))
        scope.delete(b.filter("user_id % 2 = 0").select("key"))
    return seen.unionByName(_latest(store).withColumn("at", F.lit("after")))


def kv_store_release(s: SparkSession, d: str) -> DataFrame:
    """The second run is released: it fills its lsn, unseen."""
    store = _new(s)
    a, b, c = _runs(s, d)
    store.apply(a)
    held = store.stage(b)
    later = store.stage(c)
    store.resolve(later)
    early = _latest(store).withColumn("at", F.lit("held"))
    store.resolve(held, publish=False)
    return early.unionByName(_latest(store).withColumn("at", F.lit("released")))


def kv_store_reopen(s: SparkSession, d: str) -> DataFrame:
    """A writer goes away with the third run staged; opening the table again releases it."""
    store = _new(s)
    a, b, c = _runs(s, d)
    store.apply(a)
    store.apply(b)
    store.stage(c)
    return _latest(Store.open(s, store.path))


def kv_store_restore(s: SparkSession, d: str) -> DataFrame:
    """A checkpoint of the newest row of each key, loaded into a new table; the third run on top."""
    store = _new(s)
    a, b, c = _runs(s, d)
    store.apply(a)
    store.apply(b)
    path = fresh_dir(s, "checkpoint")
    store.checkpoint(path)
    loaded = Store.restore(s, path, fresh_dir(s, "store"))
    loaded.apply(c)
    return _latest(loaded)


def kv_store_maintenance(s: SparkSession, d: str) -> DataFrame:
    """What a maintenance round after each run did, and what was left after the last."""
    store, out = _new(s), []
    for n, run in enumerate(_runs(s, d)):
        store.apply(run)
        did = store.maintain(seal_bytes=1, flush_gens=2)
        now = store.manifest()
        out.append((n, did["sealed"], did["flushed"], did["reclaimed"], len(now.sealed), len(now.pieces), now.frontier))
    return s.createDataFrame(out, "round long, sealed boolean, flushed boolean, reclaimed boolean, n_sealed long, n_pieces long, frontier long")


def kv_store_vacuum(s: SparkSession, d: str) -> DataFrame:
    """Rows, versions and log folders after old versions are deleted."""
    store = _flushed(s, d)
    store.vacuum()
    now = store.manifest()
    return _latest(store).agg(F.count("*").alias("n_rows")).withColumns({"n_versions": F.lit(len(store.versions())).cast("long"), "n_pieces": F.lit(len(now.pieces)).cast("long")})


def kv_store_stats(s: SparkSession, d: str) -> DataFrame:
    """Counters of the table."""
    return s.createDataFrame([(k, int(v)) for k, v in _flushed(s, d).stats().items() if k != "version"], "name string, value long")


def kv_store_verify(s: SparkSession, d: str) -> DataFrame:
    """Batches whose stored checksums or entry counts do not hold; none, and how many were looked at."""
    store = _flushed(s, d)
    return store.rows(store.manifest()).agg(F.count("*").alias("n_rows")).join(store.verify().agg(F.count("*").alias("n_broken")))


def kv_frame_status(s: SparkSession, d: str) -> DataFrame:
    """Frames of the log, some damaged in a known way, by the reason for which they are refused."""
    c = change_log(s, d)
    framed = frames.frame(c.withColumn("body", F.concat_ws("\0", "op", "key", F.coalesce("value", F.lit(""))).cast("binary")), "body", "gen")
    kind = F.col("seq") % 50
    data = (
        F.when(kind == 3, F.unhex(F.repeat(F.lit("00"), F.length("frame"))))
        .when(kind == 11, F.concat(F.unhex(F.lit("DEADBEEF")), F.expr("substr(frame, 5)")))
        .when(kind == 17, F.expr("substr(frame, 1, length(frame) - 1)"))
        .when(kind == 23, F.concat(F.expr("substr(frame, 1, length(frame) - 1)"), F.unhex(F.lit("FF"))))
        .otherwise(F.col("frame"))
    )
    expected = F.when(kind == 29, F.col("gen") + 1).otherwise(F.col("gen"))
    return framed.select("gen", frames.status(data, expected).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    kv_store_latest, kv_store_scan, kv_store_flush_round, kv_store_seal_round, kv_store_batch_scope, kv_store_release, kv_store_reopen, kv_store_restore, kv_store_maintenance,
    kv_store_vacuum, kv_store_stats, kv_store_verify, kv_frame_status,
)}

_RUN = f"WITH {LOG}, r AS (SELECT *, batch_id * 3 // (SELECT max(batch_id) + 1 FROM chg) AS run FROM chg)"
_W = f"SELECT key, lsn, value FROM (SELECT *, {WON} FROM r{{where}}) WHERE nth = 1 AND op = 'PUT'"
_CANON = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, key ORDER BY pos DESC) AS last FROM r) WHERE last = 1)"
SQL = {
    "kv_store_latest": f"{_RUN} {_W.format(where='')}",
    "kv_store_scan": f"""{_RUN} SELECT * FROM ({_W.format(where='')}) WHERE key >= '{_key(20)}' AND key < '{_key(60)}'""",
    "kv_store_flush_round": f"{_RUN} SELECT key, lsn, op, value FROM (SELECT *, {WON} FROM r WHERE run < 2) WHERE nth = 1 AND op = 'PUT'",
    "kv_store_seal_round": f"{_RUN}, {_CANON} SELECT run AS gen, min(lsn) AS min_lsn, max(lsn) AS max_lsn, count(*) AS n_rows FROM c GROUP BY run",
    "kv_store_batch_scope": f"""{_RUN}, e AS (SELECT key, lsn, op, value, seq FROM r WHERE run < 2 UNION ALL
  SELECT DISTINCT key, (SELECT max(lsn) + 1 FROM r WHERE run < 2), 'DEL', NULL, 9223372036854775807 FROM r WHERE run = 1 AND user_id % 2 = 0)
SELECT *, 'scope' AS at FROM ({_W.format(where=' WHERE run = 0')}) UNION ALL SELECT key, lsn, value, 'after' AS at FROM (SELECT *, {WON} FROM e) WHERE nth = 1 AND op = 'PUT'""",
    "kv_store_release": f"{_RUN} SELECT *, 'held' AS at FROM ({_W.format(where=' WHERE run = 0')}) UNION ALL SELECT *, 'released' AS at FROM ({_W.format(where=' WHERE run <> 1')})",
    "kv_store_reopen": f"{_RUN} {_W.format(where=' WHERE run < 2')}",
    "kv_store_restore": f"{_RUN} {_W.format(where='')}",
    "kv_store_maintenance": f"""{_RUN}, m AS (SELECT max(lsn) FILTER (run = 1) AS f FROM r)
SELECT n AS round, true AS sealed, n = 1 AS flushed, n = 1 AS reclaimed, CASE n WHEN 1 THEN 0 ELSE 1 END::BIGINT AS n_sealed, CASE n WHEN 1 THEN 0 ELSE 1 END::BIGINT AS n_pieces, CASE WHEN n = 0 THEN 0 ELSE f END AS frontier FROM range(3) x(n), m""",
    "kv_store_vacuum": f"{_RUN} SELECT count(*) AS n_rows, 1::BIGINT AS n_versions, 1::BIGINT AS n_pieces FROM ({_W.format(where='')})",
    "kv_store_stats": f"""{_RUN}, m AS (SELECT max(lsn) AS top, max(lsn) FILTER (run = 1) AS f FROM r)
SELECT unnest(['durable_lsn', 'next_lsn', 'frontier', 'generations', 'published', 'flushes']) AS name, unnest([top, top + 1, f, 1, top, 1]) AS value FROM m""",
    "kv_store_verify": f"{_RUN}, {_CANON} SELECT count(*) AS n_rows, 0::BIGINT AS n_broken FROM c WHERE run = 2",
    "kv_frame_status": f"WITH {LOG} SELECT CASE seq % 50 WHEN 3 THEN 'zero' WHEN 11 THEN 'bad_magic' WHEN 17 THEN 'truncated' WHEN 23 THEN 'bad_crc' WHEN 29 THEN 'bad_gen' ELSE 'ok' END AS status, count(*) AS n FROM chg GROUP BY 1",
}
