"""Cache queries over events as commands, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import cache
from siltstone.plans.kv_queries import LOG
from siltstone.sources import resp
from siltstone.sources.tables import change_log, table

#: Time to live of purchases: six hours.
TTL_MS = 6 * 3600 * 1000


def _argv(s: SparkSession, d: str) -> DataFrame:
    """view: GET; error: DEL of the key and the next user's; purchase: SET with PX; others: SET; every 50th a PING, every 51st a bad GET."""
    c = change_log(s, d)
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    nxt = F.concat(F.lit("u"), (F.col("user_id") + 1).cast("string"))
    kind = F.col("event_type")
    argv = (
        F.when(F.col("seq") % 50 == 49, F.array(F.lit("ping")))
        .when(F.col("seq") % 51 == 50, F.array(F.lit("GET")))
        .when(kind == "view", F.array(F.lit("get"), key))
        .when(kind == "error", F.array(F.lit("DEL"), key, nxt))
        .when(kind == "purchase", F.array(F.lit("SET"), key, "value", F.lit("px"), F.lit(str(TTL_MS))))
        .otherwise(F.array(F.lit("set"), key, "value"))
    )
    return c.select("seq", "ts_ms", argv.alias("argv"))


def _commands(s: SparkSession, d: str) -> DataFrame:
    return cache.parse(_argv(s, d))


def cache_parse(s: SparkSession, d: str) -> DataFrame:
    return _commands(s, d).select("seq", "verb", "key", "value", "ttl_ms", "error")


def cache_commands(s: SparkSession, d: str) -> DataFrame:
    r = cache.respond(_commands(s, d))
    return r.select("seq", "kind", resp.response(F.col("kind"), F.col("value")).alias("wire"))


def cache_ttl_state(s: SparkSession, d: str) -> DataFrame:
    return cache.final_state(_commands(s, d))


def _with_hotness(s: SparkSession, d: str) -> DataFrame:
    c = _commands(s, d)
    state = cache.final_state(c).join(cache.hotness(c), "key", "left")
    return state.withColumn("n_bytes", F.octet_length("value") + 64).select("key", "version", F.coalesce("hotness", F.lit(0)).alias("hotness"), "n_bytes", "expire_at")


def cache_expired(s: SparkSession, d: str) -> DataFrame:
    c = _commands(s, d)
    now = c.agg(F.max("ts_ms").alias("now"))
    return cache.final_state(c).join(F.broadcast(now), cache.expired("expire_at", "now")).select("key", "expire_at")


def cache_live_after_sweep(s: SparkSession, d: str) -> DataFrame:
    c = _commands(s, d)
    return cache.final_state(c).join(F.broadcast(c.agg(F.max("ts_ms").alias("now"))), ~cache.expired("expire_at", "now")).select("key", "version")


def cache_evict_coldest(s: SparkSession, d: str) -> DataFrame:
    return cache.coldest(_with_hotness(s, d), 10).select("key", "hotness")


def cache_waterline(s: SparkSession, d: str) -> DataFrame:
    return cache.water_line(_with_hotness(s, d), "n_bytes", 6_000, 60).select("key", "hotness", "freed_before")


def _tiered(s: SparkSession, d: str) -> DataFrame:
    """Keys as values of three tiers by hotness, on pages by hash of 32 bits."""
    from siltstone.functions.hashing import fnv1a32

    tier = F.when(F.col("hotness") % 3 == 0, "large").when(F.col("hotness") % 3 == 1, "slab").otherwise("inline")
    return _with_hotness(s, d).withColumn("page", fnv1a32(F.col("key")) % 16).withColumn("tier", tier)


def cache_coldest_pages(s: SparkSession, d: str) -> DataFrame:
    return cache.coldest_page(_tiered(s, d), 4)


def cache_coldest_large(s: SparkSession, d: str) -> DataFrame:
    return cache.coldest_large(_tiered(s, d), 3).select("key", "hotness")


def cache_water_levels(s: SparkSession, d: str) -> DataFrame:
    """Levels and evictions of a round, for limits around them."""
    used = s.createDataFrame([(n, m) for n in (0, 59, 60, 89, 90, 99, 100, 250) for m in (0, 100)], "used long, memory_limit long")
    level, n = cache.water_level(F.col("used"), F.col("memory_limit"))
    return used.select("used", "memory_limit", level.alias("level"), n.alias("evictions"))


def cache_evict_round(s: SparkSession, d: str) -> DataFrame:
    """What one round evicts at each level: the limit is a part of all bytes."""
    t = _tiered(s, d)
    total = t.agg(F.sum("n_bytes")).first()[0] or 0
    out = None
    for percent in (100, 95, 70, 50):
        own = cache.round_of_evictions(t, "n_bytes", total * 100 // percent).withColumn("percent", F.lit(percent))
        out = own if out is None else out.unionByName(own)
    return out


def cache_discard_page(s: SparkSession, d: str) -> DataFrame:
    """State without the keys of the coldest page; pages hold keys by hash of 32 bits."""
    from siltstone.functions.hashing import fnv1a32

    h = _with_hotness(s, d).withColumn("page", fnv1a32(F.col("key")) % 16)
    cold = h.groupBy("page").agg(F.min("hotness").alias("h")).orderBy("h", "page").limit(1).select("page")
    return h.join(cold, "page", "left_anti").select("key", "page")


def cache_page_states(s: SparkSession, d: str) -> DataFrame:
    h = _with_hotness(s, d)
    state = F.when(F.col("version") % 3 == 2, "EVICTING").otherwise("IN_MEMORY")
    return h.select("key", cache.next_state(state, F.col("version") % 2 == 1, F.col("hotness") % 2 == 0).alias("state"))


def cache_promote(s: SparkSession, d: str) -> DataFrame:
    """Cold rows of even hotness, read at the version they have, or one before for every fifth."""
    h = _with_hotness(s, d)
    cold = h.filter("hotness % 2 = 0").select("key", "version")
    reads = h.select("key", (F.col("version") - (F.col("hotness") % 5 == 0).cast("long")).alias("version"))
    return cache.promote(cold, reads)


def cache_size_class(s: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("text")
    sized = table(s, d, "documents").select(cache.tier(n).alias("tier"), cache.slot(n).alias("slot"), cache.pages(n).alias("pages"), n.alias("n"))
    return sized.groupBy("tier", "slot").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_bytes"), F.sum("pages").alias("n_pages"))


def cache_value_class(s: SparkSession, d: str) -> DataFrame:
    """The smallest of given classes that holds header and value; null above the largest."""
    n = F.octet_length("text") + 24
    classes = s.createDataFrame([(c,) for c in (256, 1024, 4096, 16384, 65536)], "class int")
    v = table(s, d, "documents").select("doc_id", n.alias("need"))
    return v.join(F.broadcast(classes), F.col("need") <= F.col("class"), "left").groupBy("doc_id").agg(F.min("class").alias("class"))


def cache_memory_size(s: SparkSession, d: str) -> DataFrame:
    given = s.createDataFrame([(x,) for x in ("512M", "2g", "64K", "4096", "1GB", "x1", "")], "size string")
    return given.select("size", cache.memory_size(F.col("size")).alias("n_bytes"))


def resp_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """The commands of 64 connections as bytes, read back."""
    c = _argv(s, d).select((F.col("seq") % 64).alias("conn"), "seq", resp.request(F.col("argv")).alias("wire"))
    streams = c.groupBy("conn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "wire"))), lambda x: x["wire"]), "").cast("binary").alias("payload"))
    back = resp.parse_streams(streams)
    return back.groupBy("conn").agg(F.count("*").alias("n_requests"), F.sum(F.size("argv")).alias("n_args"), F.sum(F.octet_length(F.array_join("argv", ""))).alias("n_bytes"))


QUERIES = {f.__name__: f for f in (
    cache_parse, cache_commands, cache_ttl_state, cache_expired, cache_live_after_sweep, cache_evict_coldest, cache_coldest_pages, cache_coldest_large, cache_water_levels, cache_evict_round, cache_waterline, cache_discard_page, cache_page_states, cache_promote,
    cache_size_class, cache_value_class, cache_memory_size, resp_roundtrip,
)}

_CMDS = f"""{LOG}, cmd AS (SELECT seq, ts_ms, 'u' || user_id AS k1, 'u' || (user_id + 1) AS k2, value AS v,
  CASE WHEN seq % 50 = 49 THEN 'PING' WHEN seq % 51 = 50 THEN 'BAD' WHEN event_type = 'view' THEN 'GET' WHEN event_type = 'error' THEN 'DEL' ELSE 'SET' END AS verb,
  CASE WHEN event_type = 'purchase' THEN {TTL_MS} ELSE -1 END AS ttl FROM chg),
one AS (SELECT seq, ts_ms, verb, CASE WHEN verb IN ('GET', 'SET', 'DEL') THEN k1 END AS key, v, CASE WHEN ttl >= 0 THEN ts_ms + ttl ELSE -1 END AS exp FROM cmd
  UNION ALL SELECT seq, ts_ms, verb, k2, v, -1 FROM cmd WHERE verb = 'DEL'),
his AS (SELECT *, last_value(CASE WHEN verb IN ('SET', 'DEL') THEN {{'verb': verb, 'v': v, 'exp': exp}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM one),
held AS (SELECT *, coalesce(was.verb = 'SET' AND NOT (was.exp >= 0 AND ts_ms >= was.exp), FALSE) AS held FROM his),
del AS (SELECT key, max(seq) AS ds FROM one WHERE verb = 'DEL' GROUP BY key),
fin AS (SELECT key, arg_max(v, seq) AS value, arg_max(exp, seq) AS expire_at, count(*) - 1 AS version FROM one LEFT JOIN del USING (key) WHERE verb = 'SET' AND (ds IS NULL OR seq > ds) GROUP BY key),
hot AS (SELECT fin.key, version, coalesce(h, 0) AS hotness, strlen(value) + 64 AS n_bytes, expire_at FROM fin LEFT JOIN (SELECT key, max(seq) AS h FROM one WHERE verb IN ('GET', 'SET') GROUP BY key) USING (key)),
clock AS (SELECT max(ts_ms) AS now FROM cmd)"""
_N = "strlen(text)"
_FNV32 = "list_reduce(list_prepend(2166136261::UHUGEINT, list_transform(string_split(key, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, x: xor(h, x) * 16777619::UHUGEINT % 4294967296::UHUGEINT)::BIGINT"

SQL = {
    "cache_parse": f"WITH {_CMDS} SELECT seq, CASE WHEN verb = 'BAD' THEN 'GET' ELSE verb END AS verb, CASE WHEN verb IN ('GET', 'SET', 'DEL') THEN k1 END AS key, CASE WHEN verb = 'SET' THEN v END AS value, CASE WHEN verb = 'SET' THEN ttl END::BIGINT AS ttl_ms, CASE WHEN verb = 'BAD' THEN 'wrong number of arguments for ''get'' command' END AS error FROM cmd",
    "cache_commands": f"""WITH {_CMDS}, r AS (SELECT seq, any_value(verb) AS verb, any_value(CASE WHEN held THEN was.v END) AS hit, bool_or(held) AS held, count(*) FILTER (held) AS n FROM held GROUP BY seq),
k AS (SELECT seq, hit, n, CASE verb WHEN 'PING' THEN 'PONG' WHEN 'BAD' THEN 'ERR' WHEN 'GET' THEN CASE WHEN held THEN 'BULK' ELSE 'NIL' END WHEN 'DEL' THEN 'INTEGER' ELSE 'OK' END AS kind FROM r)
SELECT seq, kind, CASE kind WHEN 'PONG' THEN '+PONG' || chr(13) || chr(10) WHEN 'ERR' THEN '-ERR wrong number of arguments for ''get'' command' || chr(13) || chr(10) WHEN 'NIL' THEN '$-1' || chr(13) || chr(10) WHEN 'OK' THEN '+OK' || chr(13) || chr(10)
  WHEN 'INTEGER' THEN ':' || n || chr(13) || chr(10) ELSE '$' || strlen(hit) || chr(13) || chr(10) || hit || chr(13) || chr(10) END AS wire FROM k""",
    "cache_ttl_state": f"WITH {_CMDS} SELECT * FROM fin",
    "cache_expired": f"WITH {_CMDS} SELECT key, expire_at FROM fin, clock WHERE expire_at >= 0 AND now >= expire_at",
    "cache_live_after_sweep": f"WITH {_CMDS} SELECT key, version FROM fin, clock WHERE NOT (expire_at >= 0 AND now >= expire_at)",
    "cache_evict_coldest": f"WITH {_CMDS} SELECT key, hotness FROM hot ORDER BY hotness, key LIMIT 10",
    "cache_waterline": f"WITH {_CMDS}, f AS (SELECT key, hotness, (coalesce(sum(n_bytes) OVER (ORDER BY hotness, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS freed_before, sum(n_bytes) OVER () - 3600 AS need FROM hot) SELECT key, hotness, freed_before FROM f WHERE freed_before < need",
    "cache_coldest_pages": f"WITH {_CMDS}, p AS (SELECT hotness, {_FNV32} % 16 AS page FROM hot WHERE hotness % 3 = 1) SELECT page, max(hotness) AS hotness FROM p GROUP BY page ORDER BY hotness, page LIMIT 4",
    "cache_coldest_large": f"WITH {_CMDS} SELECT key, hotness FROM hot WHERE hotness % 3 = 0 ORDER BY hotness, key LIMIT 3",
    "cache_water_levels": "SELECT u AS used, m AS memory_limit, CASE WHEN m > 0 AND u >= 100 THEN 'max' WHEN m > 0 AND u >= 90 THEN 'urgent' WHEN m > 0 AND u >= 60 THEN 'begin' END AS level, CASE WHEN m > 0 AND u >= 100 THEN 32 WHEN m > 0 AND u >= 90 THEN 8 WHEN m > 0 AND u >= 60 THEN 1 ELSE 0 END AS evictions FROM (SELECT unnest([0, 59, 60, 89, 90, 99, 100, 250])::BIGINT AS u), (SELECT unnest([0, 100])::BIGINT AS m)",
    "cache_evict_round": f"""WITH {_CMDS}, t AS (SELECT key, n_bytes, row_number() OVER o AS nth, coalesce(sum(n_bytes) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_bytes) OVER () AS used FROM hot WINDOW o AS (ORDER BY CASE WHEN hotness % 3 = 0 THEN 0 ELSE 1 END, hotness, key)),
l AS (SELECT *, used::BIGINT * 100 // percent AS lim FROM t, (SELECT unnest([100, 95, 70, 50])::INT AS percent)),
e AS (SELECT *, CASE WHEN used >= lim THEN 32 WHEN used >= floor(lim * 90 / 100) THEN 8 WHEN used >= floor(lim * 60 / 100) THEN 1 ELSE 0 END AS n FROM l)
SELECT key, CASE n WHEN 32 THEN 'max' WHEN 8 THEN 'urgent' ELSE 'begin' END AS level, percent FROM e WHERE nth <= n AND used - before >= lim * 60 // 100""",
    "cache_discard_page": f"WITH {_CMDS}, p AS (SELECT key, hotness, {_FNV32} % 16 AS page FROM hot) SELECT key, page FROM p WHERE page <> (SELECT page FROM p GROUP BY page ORDER BY min(hotness), page LIMIT 1)",
    "cache_page_states": f"WITH {_CMDS}, s AS (SELECT key, version, hotness, CASE WHEN version % 3 = 2 THEN 'EVICTING' ELSE 'IN_MEMORY' END AS st FROM hot) SELECT key, CASE WHEN st = 'IN_MEMORY' AND hotness % 2 = 0 THEN CASE WHEN version % 2 = 0 THEN 'ON_NVME' ELSE 'EVICTING' END WHEN st = 'EVICTING' AND hotness % 2 <> 0 THEN 'ON_NVME' ELSE st END AS state FROM s",
    "cache_promote": f"WITH {_CMDS} SELECT key, version FROM hot WHERE hotness % 2 = 0 AND hotness % 5 <> 0",
    "cache_size_class": f"SELECT CASE WHEN {_N} <= 16 THEN 'inline' WHEN {_N} <= 4096 THEN 'slab' ELSE 'large' END AS tier, CASE WHEN {_N} <= 16 OR {_N} > 4096 THEN NULL WHEN {_N} <= 64 THEN 64 WHEN {_N} <= 128 THEN 128 WHEN {_N} <= 256 THEN 256 WHEN {_N} <= 512 THEN 512 WHEN {_N} <= 1024 THEN 1024 WHEN {_N} <= 2048 THEN 2048 ELSE 4096 END AS slot, count(*) AS n_values, sum({_N})::BIGINT AS n_bytes, sum(({_N} + 4095) // 4096)::BIGINT AS n_pages FROM documents GROUP BY 1, 2",
    "cache_value_class": "SELECT doc_id, CASE WHEN n <= 256 THEN 256 WHEN n <= 1024 THEN 1024 WHEN n <= 4096 THEN 4096 WHEN n <= 16384 THEN 16384 WHEN n <= 65536 THEN 65536 END AS class FROM (SELECT doc_id, strlen(text) + 24 AS n FROM documents)",
    "cache_memory_size": "SELECT * FROM (VALUES ('512M', 536870912::BIGINT), ('2g', 2147483648), ('64K', 65536), ('4096', 4096), ('1GB', 1073741824), ('x1', NULL), ('', NULL)) t(size, n_bytes)",
    "resp_roundtrip": f"WITH {_CMDS}, a AS (SELECT seq % 64 AS conn, CASE verb WHEN 'PING' THEN ['ping'] WHEN 'BAD' THEN ['GET'] WHEN 'GET' THEN ['get', k1] WHEN 'DEL' THEN ['DEL', k1, k2] ELSE CASE WHEN ttl >= 0 THEN ['SET', k1, v, 'px', '{TTL_MS}'] ELSE ['set', k1, v] END END AS argv FROM cmd) SELECT conn, count(*) AS n_requests, sum(len(argv))::BIGINT AS n_args, sum(strlen(array_to_string(argv, '')))::BIGINT AS n_bytes FROM a GROUP BY conn",
}
