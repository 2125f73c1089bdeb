"""A command cache as relations: commands in, responses and final state out.

A command's effect depends on the earlier ones on its key, so everything is a
window over (key, seq); time is the command's own ``ts_ms``, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest inline value, page size, and slab slot sizes; fixed values.
INLINE, PAGE = 16, 4096
SLOTS = (64, 128, 256, 512, 1024, 2048, 4096)


def parse(argv: DataFrame) -> DataFrame:
    """(seq, ts_ms, argv) -> adds ``verb``, ``key``, ``value``, ``ttl_ms``, ``error``.

    Verbs are compared without case. The first EX or PX from the fourth argument
    on that has a successor sets the time to live (-1: none); what is not a
    leading number counts as 0.
    """
    name, n = F.upper(F.get("argv", F.lit(0))), F.size("argv")
    wrong = lambda v: F.lit(f"wrong number of arguments for '{v}' command")
    known = F.when(name.isin("GET", "SET", "DEL", "PING", "QUIT", "COMMAND", "CLIENT"), name)
    error = (
        F.when(n == 0, F.lit("empty command"))
        .when((name == "GET") & (n < 2), wrong("get"))
        .when((name == "SET") & (n < 3), wrong("set"))
        .when((name == "DEL") & (n < 2), wrong("del"))
        .when(known.isNull(), F.lit("unknown command"))
    )
    at = F.expr("filter(sequence(3, greatest(size(argv) - 2, 3)), i -> i < size(argv) - 1 AND upper(get(argv, i)) IN ('EX', 'PX'))[0]")
    number = F.coalesce(F.regexp_extract(F.expr("get(argv, _at + 1)"), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
    ttl = F.when(F.col("_at").isNull(), -1).otherwise(number * F.when(F.expr("upper(get(argv, _at)) = 'EX'"), 1000).otherwise(1))
    return (
        argv.withColumn("verb", known)
        .withColumn("error", error)
        .withColumn("_at", F.when((name == "SET") & (n > 4), at))
        .withColumn("ttl_ms", F.when(F.col("verb") == "SET", ttl).cast("long"))
        .withColumn("key", F.when(F.col("verb").isin("GET", "SET", "DEL"), F.get("argv", F.lit(1))))
        .withColumn("value", F.when(F.col("verb") == "SET", F.get("argv", F.lit(2))))
        .drop("_at")
    )


def expired(expire_at: Column | str, now: Column | str) -> Column:
    e, n = (F.col(x) if isinstance(x, str) else x for x in (expire_at, now))
    return (e >= 0) & (n >= e)


def _history(cmds: DataFrame) -> DataFrame:
    """Adds to each command the last write before it on its key: ``was`` (verb, value, expire_at), null if none.

    Commands without a key have no history and stay out of the ordering.
    """
    expire = F.when(F.col("ttl_ms") >= 0, F.col("ts_ms") + F.col("ttl_ms")).otherwise(-1)
    c = cmds.withColumn("expire_at", F.when(F.col("verb") == "SET", expire))
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.when(F.col("verb").isin("SET", "DEL"), F.struct("verb", "value", "expire_at"))
    keyed = c.filter("key IS NOT NULL").withColumn("was", F.last(wrote, ignorenulls=True).over(w))
    none = F.lit(None).cast(keyed.schema["was"].dataType)
    return keyed.unionByName(c.filter("key IS NULL").withColumn("was", none))


def _held() -> Column:
    return F.coalesce((F.col("was.verb") == "SET") & ~expired("was.expire_at", "ts_ms"), F.lit(False))


def respond(cmds: DataFrame) -> DataFrame:
    """(seq, kind, value) for parsed commands: BULK, NIL, OK, PONG, INTEGER, EMPTY_ARRAY or ERR."""
    h, held = _history(split_deletes(cmds)), _held()
    kind = (
        F.when(F.col("error").isNotNull(), "ERR")
        .when((F.col("verb") == "GET") & held, "BULK")
        .when(F.col("verb") == "GET", "NIL")
        .when(F.col("verb") == "DEL", "INTEGER")
        .when(F.col("verb") == "PING", "PONG")
        .when(F.col("verb") == "COMMAND", "EMPTY_ARRAY")
        .otherwise("OK")
    )
    rows = h.select("seq", kind.alias("kind"), F.col("error"), F.when(held, F.col("was.value")).alias("hit"), held.cast("long").alias("n"))
    one = rows.groupBy("seq").agg(F.first("kind").alias("kind"), F.first("error").alias("error"), F.first("hit").alias("hit"), F.sum("n").alias("n"))
    value = F.when(F.col("kind") == "ERR", F.col("error")).when(F.col("kind") == "BULK", F.col("hit")).when(F.col("kind") == "INTEGER", F.col("n").cast("string"))
    return one.select("seq", "kind", value.alias("value"))


def split_deletes(cmds: DataFrame) -> DataFrame:
    """A DEL of several keys as a row a key; its response counts them."""
    keys = F.when(F.col("verb") == "DEL", F.array_distinct(F.slice("argv", F.lit(2), F.size("argv")))).otherwise(F.array("key"))
    return cmds.withColumn("key", F.explode_outer(keys))


def final_state(cmds: DataFrame) -> DataFrame:
    """(key, value, expire_at, version) of keys whose last write is a SET; expired ones stay until swept.

    ``version`` counts the SETs since the last DEL, from 0. A DEL that meets an
    expired value removes it all the same.
    """
    writes = split_deletes(cmds).filter("error IS NULL AND verb IN ('SET', 'DEL')")
    expire = F.when(F.col("ttl_ms") >= 0, F.col("ts_ms") + F.col("ttl_ms")).otherwise(-1)
    w = writes.withColumn("expire_at", expire)
    deleted = w.filter("verb = 'DEL'").groupBy(F.col("key").alias("gone")).agg(F.max("seq").alias("_del"))
    kept = w.filter("verb = 'SET'").join(deleted, F.col("key") == F.col("gone"), "left").filter("_del IS NULL OR seq > _del")
    best = kept.groupBy("key").agg(F.max_by(F.struct("value", "expire_at"), "seq").alias("w"), (F.count("*") - 1).alias("version"))
    return best.select("key", "w.value", "w.expire_at", "version")


def hotness(cmds: DataFrame) -> DataFrame:
    """(key, hotness): the seq of the last command that touched it."""
    return cmds.filter("key IS NOT NULL AND error IS NULL AND verb <> 'DEL'").groupBy("key").agg(F.max("seq").alias("hotness"))


def tier(n_bytes: Column) -> Column:
    return F.when(n_bytes <= INLINE, "inline").when(n_bytes <= PAGE, "slab").otherwise("large")


def slot(n_bytes: Column) -> Column:
    """Slot size of slab values, null for others."""
    out = F.when(n_bytes <= INLINE, F.lit(None).cast("int"))
    for s in SLOTS:
        out = out.when(n_bytes <= s, s)
    return out


def pages(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / PAGE).cast("long")


def coldest(state: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of least hotness, exactly (a heap in each task, then their union)."""
    return state.orderBy("hotness", "key").limit(n)


def coldest_page(state: DataFrame, n: int) -> DataFrame:
    """The ``n`` pages (page, hotness) of slab values that were touched longest ago; a page is as hot as its hottest value."""
    return state.filter(F.col("tier") == "slab").groupBy("page").agg(F.max("hotness").alias("hotness")).orderBy("hotness", "page").limit(n)


def coldest_large(state: DataFrame, n: int) -> DataFrame:
    """The ``n`` large values of least hotness."""
    return coldest(state.filter(F.col("tier") == "large"), n)


#: Water levels as percent of the limit, and how many evictions a round starts at each; fixed values.
LEVELS = (("max", 100, 32), ("urgent", 90, 8), ("begin", 60, 1))


def water_level(used: Column, limit: Column) -> tuple[Column, Column]:
    """The level that ``used`` bytes reach, and evictions to start; null and 0 below all, or without a limit."""
    level, n = F.lit(None).cast("string"), F.lit(0)
    for name, percent, count in reversed(LEVELS):
        reached = (limit > 0) & (used >= F.floor(limit * percent / 100))
        level, n = F.when(reached, name).otherwise(level), F.when(reached, count).otherwise(n)
    return level, n


def round_of_evictions(state: DataFrame, size: str, limit: int) -> DataFrame:
    """(key, level) of what one round evicts: large values before others, coldest first, while bytes reach the begin level."""
    used = state.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_used"))
    most = max(n for _, _, n in LEVELS)
    first = state.withColumn("_rest", (F.col("tier") != "large").cast("int")).orderBy("_rest", "hotness", "key").limit(most)  # of a fixed number
    order = Window.orderBy("_rest", "hotness", "key")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level, n = water_level(F.col("_used"), F.lit(limit))
    picked = first.withColumn("_nth", F.row_number().over(order)).withColumn("_before", before).join(F.broadcast(used))
    return picked.withColumn("level", level).filter((F.col("_nth") <= n) & (F.col("_used") - F.col("_before") >= limit * 60 // 100)).select("key", "level")


def water_line(state: DataFrame, size: str, limit: int, begin: int = 60) -> DataFrame:
    """Rows to evict, coldest first, until at most ``begin`` percent of ``limit`` bytes remain.

    Hotness is cut into ranges whose sums place the line's range; only that range
    is summed row by row.
    """
    span = state.agg(F.min("hotness").alias("lo"), F.max("hotness").alias("hi"), F.sum(size).alias("total"))
    cut = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("hotness") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")))).otherwise(0)
    s = state.join(F.broadcast(span)).withColumn("_cut", cut).withColumn("_need", F.col("total") - F.lit(limit * begin // 100))
    sums = s.groupBy("_cut").agg(F.sum(size).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    s = s.join(F.broadcast(before), "_cut").filter("_before < _need")  # 256 ranges at most
    within = Window.partitionBy("_cut").orderBy("hotness", "key").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0))
    return s.withColumn("freed_before", freed).filter(F.col("freed_before") < F.col("_need")).select(*state.columns, "freed_before")


def next_state(state: Column, dirty: Column, ask: Column) -> Column:
    """Of a page: a clean one goes back to its disk copy at once, a dirty one is written first."""
    return (
        F.when((state == "IN_MEMORY") & ask & ~dirty, "ON_NVME")
        .when((state == "IN_MEMORY") & ask, "EVICTING")
        .when((state == "EVICTING") & ~ask, "ON_NVME")
        .otherwise(state)
    )


def promote(cold: DataFrame, reads: DataFrame) -> DataFrame:
    """Cold rows brought back by reads of the same version; a read of an older one is void."""
    return cold.join(reads.select("key", "version").distinct(), ["key", "version"], "left_semi")


def memory_size(text: Column) -> Column:
    """Bytes of sizes like 512M or 2g; null for what is none."""
    n, unit = F.regexp_extract(text, r"^(\d+)([KMGkmg]?)B?$", 1), F.upper(F.regexp_extract(text, r"^(\d+)([KMGkmg]?)B?$", 2))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.when(n != "", n.try_cast("bigint") * factor.cast("bigint"))
