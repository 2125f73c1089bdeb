"""Key-value queries over the change log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.hashing import crc32c, first_bytes_mod, fnv1a32, fnv1a64, unsigned_mod
from siltstone.operators import fold, log, reads, recovery, shards
from siltstone.sources.binary import decode_batches, encode_batches
from siltstone.sources.tables import change_log, table

#: SQL of the change log; see ``change_log``.
LOG = """chg AS (SELECT 'user' || lpad(user_id::VARCHAR, 20, '0') AS key, user_id, event_id // 64 AS batch_id, event_id % 64 AS pos, event_id // 64 + 1 AS lsn,
  (event_id // 64 + 1) // 16 AS gen, user_id % 4 AS front, event_id AS seq, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op,
  CASE WHEN event_type <> 'error' THEN event_type || ':' || props END AS value, epoch_us(ts) // 1000 AS ts_ms, event_type FROM events),
half AS (SELECT max(lsn) // 2 AS h FROM chg)"""
WON = "row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS nth"


def _half(c: DataFrame) -> DataFrame:
    return c.agg(F.expr("max(lsn) DIV 2").alias("h"))


def _key(n: int) -> str:
    return f"user{n:020d}"


def kv_latest(s: SparkSession, d: str) -> DataFrame:
    return reads.live(reads.winners(change_log(s, d)))


def _snapshot(s: SparkSession, d: str) -> reads.Snapshot:
    c = change_log(s, d)
    return reads.Snapshot(c, _half(c))


def kv_as_of_lsn(s: SparkSession, d: str) -> DataFrame:
    return reads.live(reads.winners(_snapshot(s, d).rows()))


def kv_point_get(s: SparkSession, d: str) -> DataFrame:
    """Point reads of the first live key, the first deleted one, and one that never was."""
    snap = _snapshot(s, d)
    ends = reads.winners(snap.rows()).agg(F.min(F.when(F.col("op") == "PUT", F.col("key"))).alias("live"), F.min(F.when(F.col("op") == "DEL", F.col("key"))).alias("gone")).first()
    out = None
    for asked in ("live", "gone", "none"):
        key = "user" if asked == "none" else ends[asked] or "user"
        own = snap.get(key).select(F.lit(asked).alias("asked"), "key", "lsn", "value")
        out = own if out is None else out.unionByName(own)
    return out


def kv_multi_get(s: SparkSession, d: str) -> DataFrame:
    keys = s.range(40).select(F.col("id").alias("pos"), F.concat(F.lit("user"), F.lpad((F.col("id") * 7 % 200).cast("string"), 20, "0")).alias("key"))
    return _snapshot(s, d).multi_get(keys)


def kv_range_scan(s: SparkSession, d: str) -> DataFrame:
    return _snapshot(s, d).scan(_key(20), _key(60))


def kv_scan_keep_tombstones(s: SparkSession, d: str) -> DataFrame:
    return _snapshot(s, d).scan(_key(20), _key(60), keep_tombstones=True)


def kv_scan_limit(s: SparkSession, d: str) -> DataFrame:
    return _snapshot(s, d).page(None, 50)


def kv_scan_next_page(s: SparkSession, d: str) -> DataFrame:
    return _snapshot(s, d).page(_key(63), 50)


def kv_layered_get(s: SparkSession, d: str) -> DataFrame:
    """Memtable generations over a tree folded at half the log."""
    c = change_log(s, d)
    h = _half(c)
    base = reads.winners(c.join(F.broadcast(h), F.col("lsn") <= F.col("h"))).select("key", "lsn", "op", "value", F.lit(1).alias("layer"))
    mem = c.join(F.broadcast(h), F.col("lsn") > F.col("h")).groupBy("key", "gen").agg(F.max_by(F.struct("lsn", "op", "value"), "seq").alias("w"))
    mem = mem.select("key", "w.lsn", "w.op", "w.value", F.lit(0).alias("layer"))
    return reads.by_layer(mem.unionByName(base)).filter("op = 'PUT'").drop("op")


def kv_canonical_batch(s: SparkSession, d: str) -> DataFrame:
    return log.canonicalize(change_log(s, d)).select("batch_id", "pos", "key", "op", "value")


def kv_lsn_assign(s: SparkSession, d: str) -> DataFrame:
    """Batches whose first operation is not a DEL are accepted; they are numbered without gaps."""
    first = change_log(s, d).filter("pos = 0 AND op = 'PUT'").select("batch_id")
    return log.dense_numbers(first, "batch_id", "assigned_lsn", 64)


def _status(s: SparkSession, d: str) -> DataFrame:
    """A status for each lsn: every 97th pending, every 11th released, others published."""
    status = F.when(F.col("lsn") % 97 == 96, "pending").when(F.col("lsn") % 11 == 5, "released").otherwise("published")
    return change_log(s, d).select("lsn").distinct().withColumn("status", status)


def kv_durable_prefix(s: SparkSession, d: str) -> DataFrame:
    return log.durable_prefix(_status(s, d).filter("status <> 'pending'"))


def kv_publish_gate(s: SparkSession, d: str) -> DataFrame:
    return log.gated_prefix(_status(s, d).filter("status <> 'pending'"), F.lit(10), F.lit(1_000_000))


def kv_visible_with_release(s: SparkSession, d: str) -> DataFrame:
    return reads.live(reads.winners(log.visible(change_log(s, d), _status(s, d))))


def kv_fold_generations(s: SparkSession, d: str) -> DataFrame:
    c = change_log(s, d)
    return reads.winners(c.join(F.broadcast(c.agg(F.max("gen").alias("top"))), F.col("gen") < F.col("top")))


def kv_fold_losers(s: SparkSession, d: str) -> DataFrame:
    return fold.fold_losers(change_log(s, d)).select("key", "seq", "lsn", "value")


def _base_and_delta(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = change_log(s, d)
    h = _half(c)
    base = reads.winners(c.join(F.broadcast(h), F.col("lsn") <= F.col("h")))
    delta = reads.winners(c.join(F.broadcast(h), F.col("lsn") > F.col("h")))
    return base, delta, c


def kv_leaf_merge(s: SparkSession, d: str) -> DataFrame:
    base, delta, c = _base_and_delta(s, d)
    return fold.leaf_merge(base, delta, c.agg(F.expr("max(lsn) * 3 DIV 4").alias("x")))


def kv_page_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = kv_latest(s, d).select("key", (F.octet_length("key") + F.octet_length("value")).alias("n_bytes"), F.substring("key", 22, 2).alias("shard"))
    return fold.page_chunks(rows, 512, "shard")


def kv_safe_lsn(s: SparkSession, d: str) -> DataFrame:
    c = change_log(s, d)
    h = F.broadcast(_half(c))
    return log.safe_lsn(c.join(h, F.col("lsn") <= F.col("h")), c.join(h, (F.col("lsn") > F.col("h")) & (F.col("front") == 3)))


def kv_reclaimable_values(s: SparkSession, d: str) -> DataFrame:
    c = change_log(s, d)
    return fold.fold_losers(c).join(F.broadcast(_half(c)), F.col("lsn") <= F.col("h")).select("key", "seq", "lsn")


def kv_snapshot_gc(s: SparkSession, d: str) -> DataFrame:
    """Snapshots (one a generation) that no reader pins; readers are those of every third."""
    snaps = change_log(s, d).select(F.col("gen").alias("snapshot")).distinct()
    return snaps.join(snaps.filter("snapshot % 3 = 0"), "snapshot", "left_anti")


def kv_generations(s: SparkSession, d: str) -> DataFrame:
    return fold.generations(change_log(s, d))


def kv_eligible_gens(s: SparkSession, d: str) -> DataFrame:
    return fold.eligible(fold.generations(change_log(s, d)), kv_durable_prefix(s, d))


def kv_frontier_subtract(s: SparkSession, d: str) -> DataFrame:
    gens = fold.generations(change_log(s, d)).select("gen", "n_rows")
    return gens.join(kv_eligible_gens(s, d).select("gen"), "gen", "left_anti")


def kv_pressure(s: SparkSession, d: str) -> DataFrame:
    c = change_log(s, d)
    return fold.pressure(fold.generations(c), c.select("front", "gen"), c.agg(F.max("gen").alias("g")), 10_000, 4)


def kv_log_reclaim(s: SparkSession, d: str) -> DataFrame:
    """Log segments (one a generation and front) wholly at or below half the log."""
    c = change_log(s, d)
    seg = c.groupBy("front", "gen").agg(F.max("lsn").alias("max_lsn"))
    return seg.join(F.broadcast(_half(c)), F.col("max_lsn") <= F.col("h")).drop("h")


def _wal(s: SparkSession, d: str) -> DataFrame:
    """The canonical log as segments of 8 lsn; every 40th lsn lost an entry, and every 5th segment is torn at its 100th entry."""
    c = log.canonicalize(change_log(s, d))
    counts = c.groupBy("lsn").agg(F.count("*").alias("entry_count"))
    w = c.join(counts, "lsn").filter("NOT (lsn % 40 = 7 AND pos = 0)")
    place = F.col("lsn") % 8 * 64 + F.col("pos")
    segment = F.expr("lsn DIV 8")
    return w.select(segment.alias("segment"), place.alias("pos"), "lsn", "entry_count", "op", "key", "value", (~((segment % 5 == 4) & (place == F.lit(100)))).alias("ok"))


def kv_recovery_torn_tail(s: SparkSession, d: str) -> DataFrame:
    return recovery.untorn(_wal(s, d)).groupBy("segment").agg(F.count("*").alias("n_kept"))


def kv_recovery_complete(s: SparkSession, d: str) -> DataFrame:
    return recovery.complete(recovery.untorn(_wal(s, d)))


def kv_recovery_replay(s: SparkSession, d: str) -> DataFrame:
    return recovery.replay(recovery.untorn(_wal(s, d)))


def kv_recovery_merge(s: SparkSession, d: str) -> DataFrame:
    base, _, _ = _base_and_delta(s, d)
    return recovery.merge(base, kv_recovery_replay(s, d))


def kv_recovery_uncovered(s: SparkSession, d: str) -> DataFrame:
    base, _, _ = _base_and_delta(s, d)
    return recovery.uncovered(base, kv_recovery_replay(s, d))


def kv_recovery_boot(s: SparkSession, d: str) -> DataFrame:
    base, _, _ = _base_and_delta(s, d)
    blocks = s.createDataFrame([(4, 40, True), (5, 50, True), (6, 60, False)], "epoch int, root int, valid boolean")
    return recovery.boot(blocks, base, _wal(s, d))


def _shards(s: SparkSession) -> DataFrame:
    ends = [None, _key(30), _key(75), _key(110), None]
    return s.createDataFrame([(i, ends[i], ends[i + 1]) for i in range(4)], "shard int, lower string, upper string")


def kv_shard_route(s: SparkSession, d: str) -> DataFrame:
    return shards.route(change_log(s, d).select("key").distinct(), _shards(s))


def kv_shard_runs(s: SparkSession, d: str) -> DataFrame:
    return shards.route(kv_fold_generations(s, d).select("key"), _shards(s)).groupBy("shard").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def kv_shard_rebuild(s: SparkSession, d: str) -> DataFrame:
    """Leaves are runs of 8 keys in key order, numbered by user; four domains."""
    leaf = change_log(s, d).select("key", F.expr("user_id DIV 8").alias("leaf")).distinct().groupBy("leaf").agg(F.max("key").alias("upper"))
    numbered = log.dense_numbers(leaf, "leaf", "nth", 1024).withColumn("nth", F.col("nth") - 1)
    return shards.rebuild(numbered.join(F.broadcast(leaf.agg(F.count("*").alias("n")))).select("nth", "n", "upper"), 4)


def kv_fragment_routing(s: SparkSession, d: str) -> DataFrame:
    """Owner front of each canonical operation by FNV-1a of 64 bits; a distinct key is hashed once."""
    c = log.canonicalize(change_log(s, d)).select("batch_id", "pos", "key")
    owner = c.select("key").distinct().withColumn("owner", unsigned_mod(fnv1a64("key"), 4))
    return c.join(owner, "key").groupBy("batch_id", "owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("positions"))


def kv_store_routing(s: SparkSession, d: str) -> DataFrame:
    """Owner by FNV-1a of 32 bits and by the first four key bytes."""
    k = change_log(s, d).select("key", F.substring("key", 20, 5).alias("tail")).distinct()
    return k.select("key", fnv1a32(F.col("key")).alias("hash"), (fnv1a32(F.col("key")) % 8).alias("store"), first_bytes_mod(F.col("tail"), 7).alias("by_bytes"))


def kv_value_crc(s: SparkSession, d: str) -> DataFrame:
    """Values whose checksum holds after a round trip of the batch encoding; none is lost."""
    c = log.canonicalize(change_log(s, d)).select("batch_id", "pos", "op", "key", "value")
    back = decode_batches(encode_batches(c))
    return back.filter("error IS NULL AND op = 'PUT'").select("batch_id", "pos", "key", crc32c("value").alias("crc32c"))


def kv_batch_roundtrip(s: SparkSession, d: str) -> DataFrame:
    c = log.canonicalize(change_log(s, d)).select("batch_id", "pos", "op", "key", "value")
    return decode_batches(encode_batches(c)).groupBy("batch_id").agg(F.count("*").alias("n_ops"), F.count_if(F.col("op") == "DEL").alias("n_deletes"), F.count("error").alias("n_errors"))


QUERIES = {f.__name__: f for f in (
    kv_latest, kv_as_of_lsn, kv_point_get, kv_multi_get, kv_range_scan, kv_scan_keep_tombstones, kv_scan_limit, kv_scan_next_page, kv_layered_get, kv_canonical_batch,
    kv_lsn_assign, kv_durable_prefix, kv_publish_gate, kv_visible_with_release, kv_fold_generations, kv_fold_losers, kv_leaf_merge, kv_page_chunks, kv_safe_lsn, kv_reclaimable_values,
    kv_snapshot_gc, kv_generations, kv_eligible_gens, kv_frontier_subtract, kv_pressure, kv_log_reclaim, kv_recovery_torn_tail, kv_recovery_complete, kv_recovery_replay,
    kv_recovery_merge, kv_recovery_uncovered, kv_recovery_boot, kv_shard_route, kv_shard_runs, kv_shard_rebuild, kv_fragment_routing, kv_store_routing, kv_value_crc, kv_batch_roundtrip,
)}

_AT_HALF = f"w AS (SELECT *, {WON} FROM chg, half WHERE lsn <= h)"
_CANON = "canon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, key ORDER BY pos DESC) AS n FROM chg) WHERE n = 1)"
_STATUS = "st AS (SELECT DISTINCT lsn, CASE WHEN lsn % 97 = 96 THEN 'pending' WHEN lsn % 11 = 5 THEN 'released' ELSE 'published' END AS status FROM chg)"
_DURABLE = "dur AS (SELECT coalesce(max(lsn), 0)::BIGINT AS durable_lsn FROM (SELECT lsn, lsn - row_number() OVER (ORDER BY lsn) AS gap FROM st WHERE status <> 'pending') WHERE gap = 0)"
_GENS = "gens AS (SELECT gen, min(lsn) AS min_lsn, max(lsn) AS max_lsn, count(*) AS n_rows, sum(strlen(key) + coalesce(strlen(value), 0) + 64)::BIGINT AS n_bytes FROM chg GROUP BY gen)"
_WAL = f"""{_CANON}, ec AS (SELECT lsn, count(*) AS entry_count FROM canon GROUP BY lsn),
wal AS (SELECT lsn // 8 AS segment, lsn % 8 * 64 + pos AS p, lsn, entry_count, op, key, value, NOT (lsn // 8 % 5 = 4 AND lsn % 8 * 64 + pos = 100) AS ok FROM canon JOIN ec USING (lsn) WHERE NOT (lsn % 40 = 7 AND pos = 0)),
good AS (SELECT wal.* FROM wal LEFT JOIN (SELECT segment, min(p) AS bad FROM wal WHERE NOT ok GROUP BY segment) b USING (segment) WHERE bad IS NULL OR p < bad),
comp AS (SELECT lsn, count(*) AS n_entries FROM good GROUP BY lsn HAVING count(*) = max(entry_count)),
rep AS (SELECT key, lsn, op, value FROM (SELECT good.*, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS n FROM good JOIN comp USING (lsn)) WHERE n = 1),
base AS (SELECT key, lsn, op, value FROM (SELECT *, {WON} FROM chg, half WHERE lsn <= h) WHERE nth = 1)"""
_SHARDS = "sh(shard, lower, upper) AS (VALUES (0, NULL, '{0}'), (1, '{0}', '{1}'), (2, '{1}', '{2}'), (3, '{2}', NULL))".format(_key(30), _key(75), _key(110))
_IN_SHARD = "(lower IS NULL OR key >= lower) AND (upper IS NULL OR key < upper)"
_FNV32 = "list_reduce(list_prepend(2166136261::UHUGEINT, list_transform(string_split({k}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, x: xor(h, x) * 16777619::UHUGEINT % 4294967296::UHUGEINT)"
_FNV64 = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({k}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, x: xor(h, x) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT)"


def _sql(ctes: str, body: str) -> str:
    return f"WITH {LOG}{', ' if ctes else ''}{ctes} {body}"


SQL = {
    "kv_latest": _sql(f"w AS (SELECT *, {WON} FROM chg)", "SELECT key, lsn, value FROM w WHERE nth = 1 AND op = 'PUT'"),
    "kv_as_of_lsn": _sql(_AT_HALF, "SELECT key, lsn, value FROM w WHERE nth = 1 AND op = 'PUT'"),
    "kv_point_get": _sql(_AT_HALF, f"SELECT 'live' AS asked, key, lsn, value FROM w WHERE nth = 1 AND op = 'PUT' ORDER BY key LIMIT 1"),
    "kv_multi_get": _sql(f"{_AT_HALF}, k AS (SELECT i AS pos, 'user' || lpad((i * 7 % 200)::VARCHAR, 20, '0') AS key FROM range(40) r(i))", "SELECT k.pos, k.key, w.lsn IS NOT NULL AS found, w.lsn, w.value FROM k LEFT JOIN w ON k.key = w.key AND nth = 1 AND op = 'PUT'"),
    "kv_range_scan": _sql(_AT_HALF, f"SELECT key, lsn, value FROM w WHERE nth = 1 AND op = 'PUT' AND key >= '{_key(20)}' AND key < '{_key(60)}'"),
    "kv_scan_keep_tombstones": _sql(_AT_HALF, f"SELECT key, lsn, op, value FROM w WHERE nth = 1 AND key >= '{_key(20)}' AND key < '{_key(60)}'"),
    "kv_scan_limit": _sql(_AT_HALF, "SELECT key, lsn, value FROM w WHERE nth = 1 AND op = 'PUT' ORDER BY key LIMIT 50"),
    "kv_scan_next_page": _sql(_AT_HALF, f"SELECT key, lsn, value FROM w WHERE nth = 1 AND op = 'PUT' AND key > '{_key(63)}' ORDER BY key LIMIT 50"),
    "kv_layered_get": _sql(f"w AS (SELECT *, {WON}, CASE WHEN lsn <= h THEN 1 ELSE 0 END AS layer FROM chg, half)", "SELECT key, lsn, value, layer FROM w WHERE nth = 1 AND op = 'PUT'"),
    "kv_canonical_batch": _sql(_CANON, "SELECT batch_id, pos, key, op, value FROM canon"),
    "kv_lsn_assign": _sql("", "SELECT batch_id, row_number() OVER (ORDER BY batch_id) AS assigned_lsn FROM chg WHERE pos = 0 AND op = 'PUT'"),
    "kv_durable_prefix": _sql(f"{_STATUS}, {_DURABLE}", "SELECT durable_lsn FROM dur"),
    "kv_publish_gate": _sql(f"{_STATUS}, {_DURABLE}", "SELECT durable_lsn, CASE WHEN durable_lsn >= 10 THEN 9 ELSE durable_lsn END::BIGINT AS visible_lsn FROM dur"),
    "kv_visible_with_release": _sql(f"{_STATUS}, {_DURABLE}, w AS (SELECT chg.*, {WON} FROM chg JOIN st USING (lsn), dur WHERE status = 'published' AND lsn <= durable_lsn)", "SELECT key, lsn, value FROM w WHERE nth = 1 AND op = 'PUT'"),
    "kv_fold_generations": _sql(f"w AS (SELECT *, {WON} FROM chg WHERE gen < (SELECT max(gen) FROM chg))", "SELECT key, lsn, op, value FROM w WHERE nth = 1"),
    "kv_fold_losers": _sql(f"w AS (SELECT *, {WON} FROM chg)", "SELECT key, seq, lsn, value FROM w WHERE nth > 1 AND op = 'PUT'"),
    "kv_leaf_merge": _sql(
        f"b AS (SELECT * FROM (SELECT *, {WON} FROM chg, half WHERE lsn <= h) WHERE nth = 1), d AS (SELECT * FROM (SELECT *, {WON} FROM chg, half WHERE lsn > h) WHERE nth = 1), "
        "m AS (SELECT coalesce(d.key, b.key) AS key, coalesce(d.lsn, b.lsn) AS lsn, coalesce(d.op, b.op) AS op, CASE WHEN d.key IS NULL THEN b.value ELSE d.value END AS value, CASE WHEN d.key IS NOT NULL THEN b.lsn END AS retired FROM b FULL JOIN d ON b.key = d.key)",
        "SELECT * FROM m WHERE NOT (op = 'DEL' AND lsn <= (SELECT max(lsn) * 3 // 4 FROM chg))",
    ),
    "kv_safe_lsn": _sql("", "SELECT least((SELECT max(lsn) FROM chg, half WHERE lsn <= h), (SELECT min(lsn) - 1 FROM chg, half WHERE lsn > h AND front = 3)) AS safe_lsn"),
    "kv_reclaimable_values": _sql(f"w AS (SELECT *, {WON} FROM chg)", "SELECT key, seq, lsn FROM w, half WHERE nth > 1 AND op = 'PUT' AND lsn <= h"),
    "kv_snapshot_gc": _sql("", "SELECT DISTINCT gen AS snapshot FROM chg WHERE gen % 3 <> 0"),
    "kv_generations": _sql(_GENS, "SELECT * FROM gens"),
    "kv_eligible_gens": _sql(f"{_GENS}, {_STATUS}, {_DURABLE}", "SELECT gens.* FROM gens, dur WHERE max_lsn <= durable_lsn"),
    "kv_frontier_subtract": _sql(f"{_GENS}, {_STATUS}, {_DURABLE}", "SELECT gen, n_rows FROM gens, dur WHERE max_lsn > durable_lsn"),
    "kv_pressure": _sql(
        f"{_GENS}, t AS (SELECT max(gen) AS top FROM chg), a AS (SELECT coalesce(sum(n_bytes) FILTER (gen = top), 0)::BIGINT AS active_bytes, coalesce(sum(n_bytes) FILTER (gen <> top), 0)::BIGINT AS sealed_bytes FROM gens, t), "
        "f AS (SELECT coalesce(max(n), 0) AS max_sealed_gens FROM (SELECT front, count(DISTINCT gen) AS n FROM chg, t WHERE gen <> top GROUP BY front))",
        "SELECT *, active_bytes >= 10000 AS should_seal, max_sealed_gens >= 4 AS should_flush FROM a, f",
    ),
    "kv_log_reclaim": _sql("", "SELECT front, gen, max_lsn FROM (SELECT front, gen, max(lsn) AS max_lsn FROM chg GROUP BY front, gen), half WHERE max_lsn <= h"),
    "kv_recovery_torn_tail": _sql(_WAL, "SELECT segment, count(*) AS n_kept FROM good GROUP BY segment"),
    "kv_recovery_complete": _sql(_WAL, "SELECT lsn, n_entries FROM comp"),
    "kv_recovery_replay": _sql(_WAL, "SELECT key, lsn, op, value FROM rep"),
    "kv_recovery_merge": _sql(_WAL, "SELECT coalesce(b.key, r.key) AS key, CASE WHEN b.key IS NULL OR r.lsn > b.lsn THEN r.lsn ELSE b.lsn END AS lsn, CASE WHEN b.key IS NULL OR r.lsn > b.lsn THEN r.op ELSE b.op END AS op, CASE WHEN b.key IS NULL OR r.lsn > b.lsn THEN r.value ELSE b.value END AS value, CASE WHEN b.key IS NULL OR r.lsn > b.lsn THEN 'wal' ELSE 'tree' END AS origin FROM base b FULL JOIN rep r ON b.key = r.key"),
    "kv_recovery_uncovered": _sql(_WAL, "SELECT key, lsn, op, value FROM rep WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.key = rep.key AND b.lsn >= rep.lsn)"),
    "kv_recovery_boot": _sql(_WAL, "SELECT 50 AS root, greatest((SELECT max(lsn) FROM base), (SELECT max(lsn) FROM comp)) AS durable_lsn, greatest((SELECT max(lsn) FROM base), (SELECT max(lsn) FROM comp)) + 1 AS next_lsn"),
    "kv_shard_route": _sql(_SHARDS, f"SELECT DISTINCT key, shard FROM chg JOIN sh ON {_IN_SHARD}"),
    "kv_shard_runs": _sql(_SHARDS, f"SELECT shard, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM (SELECT DISTINCT key FROM chg WHERE gen < (SELECT max(gen) FROM chg)) JOIN sh ON {_IN_SHARD} GROUP BY shard"),
    "kv_shard_rebuild": _sql(
        "lf AS (SELECT user_id // 8 AS leaf, max(key) AS upper FROM chg GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY leaf) - 1 AS nth, count(*) OVER () AS n, upper FROM lf), "
        "s AS (SELECT i AS shard, (i + 1) * n // least(4, n) - 1 AS at, least(4, n) AS p FROM range(4) r(i), (SELECT DISTINCT n FROM o) WHERE i < least(4, n))",
        "SELECT shard::BIGINT AS shard, lag(upper) OVER (ORDER BY shard) AS lower, CASE WHEN shard < p - 1 THEN upper END AS upper FROM s JOIN o ON o.nth = s.at",
    ),
    "kv_fragment_routing": _sql(f"{_CANON}, k AS (SELECT key, ({_FNV64.format(k='key')} % 4)::BIGINT AS owner FROM (SELECT DISTINCT key FROM chg))", "SELECT batch_id, owner, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM canon JOIN k USING (key) GROUP BY batch_id, owner"),
    "kv_store_routing": _sql(f"k AS (SELECT DISTINCT key, {_FNV32.format(k='key')}::BIGINT AS hash, substr(key, 20, 4) AS t FROM chg)", "SELECT key, hash, hash % 8 AS store, (ascii(t[1]) + 256 * ascii(t[2]) + 65536 * ascii(t[3]) + 16777216 * ascii(t[4]))::BIGINT % 7 AS by_bytes FROM k"),
    "kv_batch_roundtrip": _sql(_CANON, "SELECT batch_id, count(*) AS n_ops, count(*) FILTER (op = 'DEL') AS n_deletes, 0::BIGINT AS n_errors FROM canon GROUP BY batch_id"),
}
