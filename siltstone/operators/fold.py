"""Folding generations, merging them into a base, and what may then be dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(log: DataFrame) -> DataFrame:
    """Every version with its rank within its key, newest first."""
    return log.withColumn("version_rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc())))


def fold_losers(log: DataFrame) -> DataFrame:
    """Overwritten values (tombstones hold no value to retire)."""
    return ranked(log).filter("version_rank > 1 AND op = 'PUT'")


def leaf_merge(base: DataFrame, delta: DataFrame, safe_lsn: int | DataFrame) -> DataFrame:
    """Base and delta winners, one row a key: the delta's replaces the base's.

    ``retired`` is the version that was replaced. Tombstones at or below the safe
    lsn are dropped, after the merge: earlier, they would uncover old values.
    """
    b = base.select("key", F.struct("lsn", "op", "value").alias("b"))
    d = delta.select("key", F.struct("lsn", "op", "value").alias("d"))
    merged = b.join(d, "key", "full").select("key", F.coalesce("d", "b").alias("w"), F.when(F.col("d").isNotNull(), F.col("b.lsn")).alias("retired"))
    merged = merged.select("key", F.col("w.lsn").alias("lsn"), F.col("w.op").alias("op"), F.col("w.value").alias("value"), "retired")
    if isinstance(safe_lsn, int):
        return merged.filter(~((F.col("op") == "DEL") & (F.col("lsn") <= safe_lsn)))
    at = safe_lsn.toDF("_safe")
    return merged.join(F.broadcast(at), ~((F.col("op") == "DEL") & (F.col("lsn") <= F.col("_safe")))).drop("_safe")


def generations(log: DataFrame) -> DataFrame:
    """(gen, min_lsn, max_lsn, rows, bytes): keys and values plus a fixed 64 bytes an entry."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 64
    return log.groupBy("gen").agg(F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.count("*").alias("n_rows"), F.sum(size).cast("long").alias("n_bytes"))


def eligible(gens: DataFrame, durable: DataFrame) -> DataFrame:
    """Generations that are durable as a whole, so may be flushed."""
    return gens.join(F.broadcast(durable), F.col("max_lsn") <= F.col("durable_lsn")).drop("durable_lsn")


def pressure(gens: DataFrame, fronts: DataFrame, active_gen: DataFrame, seal_bytes: int, flush_gens: int) -> DataFrame:
    """One row: bytes active and sealed, most sealed generations of a front, and what to do."""
    at = active_gen.toDF("active")
    g = gens.join(F.broadcast(at)).agg(
        F.coalesce(F.sum(F.when(F.col("gen") == F.col("active"), F.col("n_bytes"))), F.lit(0)).alias("active_bytes"),
        F.coalesce(F.sum(F.when(F.col("gen") != F.col("active"), F.col("n_bytes"))), F.lit(0)).alias("sealed_bytes"),
    )
    f = fronts.join(F.broadcast(at), F.col("gen") != F.col("active")).groupBy("front").agg(F.countDistinct("gen").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_sealed_gens"))
    return g.crossJoin(f).select("*", (F.col("active_bytes") >= seal_bytes).alias("should_seal"), (F.col("max_sealed_gens") >= flush_gens).alias("should_flush"))


def page_chunks(rows: DataFrame, page_bytes: int, shard: str) -> DataFrame:
    """Adds ``page``: rows of a shard in key order fill pages one after the other, a page until the next row would not fit.

    Greedy filling depends on all earlier rows, so a shard is one group; shards
    are as small as they are cut.
    """
    import pandas as pd

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        page, used, out = 0, 0, []
        for n in pdf["n_bytes"]:
            if used and used + n > page_bytes:
                page, used = page + 1, 0
            used += n
            out.append(page)
        return pdf.assign(page=out)

    return rows.groupBy(shard).applyInPandas(fill, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", page int")
