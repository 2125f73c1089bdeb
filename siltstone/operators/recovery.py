"""Replay of a write-ahead log after a crash.

Log rows are (segment, pos, lsn, entry_count, op, key, value, ok): ``ok`` is
whether the entry's frame checks, ``entry_count`` how many entries its lsn wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def untorn(wal: DataFrame) -> DataFrame:
    """Entries before their segment's first bad one."""
    bad = wal.filter("NOT ok").groupBy("segment").agg(F.min("pos").alias("bad_pos"))
    return wal.join(bad, "segment", "left").filter("bad_pos IS NULL OR pos < bad_pos").drop("bad_pos")


def complete(wal: DataFrame) -> DataFrame:
    """(lsn, n_entries) of the lsn all of whose entries were seen.

    Conflicting entry counts, or a key twice in one lsn, mean a broken log: an error.
    """
    one = wal.groupBy("lsn").agg(F.count("*").alias("n_entries"), F.min("entry_count").alias("lo"), F.max("entry_count").alias("hi"), F.count_distinct("key").alias("n_keys"))
    fine = (F.col("lo") == F.col("hi")) & (F.col("n_keys") == F.col("n_entries"))
    error = F.raise_error(F.concat(F.lit("broken log at lsn "), F.col("lsn").cast("string"))).cast("boolean")
    return one.filter(F.when(fine, F.col("n_entries") == F.col("hi")).otherwise(error)).select("lsn", "n_entries")


def replay(wal: DataFrame) -> DataFrame:
    """The newest entry of each key over complete lsn."""
    kept = wal.join(complete(wal).select("lsn"), "lsn", "left_semi")
    best = kept.groupBy("key").agg(F.max_by(F.struct("lsn", "op", "value"), "lsn").alias("w"))
    return best.select("key", "w.lsn", "w.op", "w.value")


def merge(tree: DataFrame, replayed: DataFrame) -> DataFrame:
    """Tree and replayed winners; a strictly newer log entry replaces the tree's. ``origin`` names the winner's side.

    One version on both sides must agree in kind, else an error.
    """
    t = tree.select("key", F.struct("lsn", "op", "value").alias("t"))
    w = replayed.select("key", F.struct("lsn", "op", "value").alias("w"))
    both = t.join(w, "key", "full")
    fine = F.col("t").isNull() | F.col("w").isNull() | (F.col("t.lsn") != F.col("w.lsn")) | (F.col("t.op") == F.col("w.op"))
    agreed = both.filter(F.when(fine, True).otherwise(F.raise_error(F.lit("tree and log disagree")).cast("boolean")))
    newer = F.col("t").isNull() | (F.col("w.lsn") > F.col("t.lsn"))
    out = agreed.select("key", F.when(newer, F.col("w")).otherwise(F.col("t")).alias("x"), F.when(newer, "wal").otherwise("tree").alias("origin"))
    return out.select("key", "x.lsn", "x.op", "x.value", "origin")


def uncovered(tree: DataFrame, replayed: DataFrame) -> DataFrame:
    """Replayed entries that the tree does not hold yet; none means that the log adds nothing."""
    t = tree.select("key", F.col("lsn").alias("tree_lsn"))
    return replayed.join(t, (replayed["key"] == t["key"]) & (F.col("tree_lsn") >= F.col("lsn")), "left_anti")


def boot(superblocks: DataFrame, tree: DataFrame, wal: DataFrame) -> DataFrame:
    """One row: the valid superblock of the largest epoch, the durable lsn after replay, and the next lsn."""
    block = superblocks.filter("valid").agg(F.max_by("root", "epoch").alias("root"))
    top = tree.agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("t"))
    log = complete(untorn(wal)).agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("w"))
    return block.crossJoin(top).crossJoin(log).select("root", F.greatest("t", "w").alias("durable_lsn"), (F.greatest("t", "w") + 1).alias("next_lsn"))
