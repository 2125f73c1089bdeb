"""Routing keys to shards and fronts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def route(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds ``shard``: the one whose [lower, upper) holds the key; a null end is open.

    ``shards`` has a row for each shard of a map, which is broadcast only below
    the session's threshold; the bounds are compared as a range join.
    """
    inside = (F.col("lower").isNull() | (F.col("key") >= F.col("lower"))) & (F.col("upper").isNull() | (F.col("key") < F.col("upper")))
    return keys.join(shards, inside).drop("lower", "upper")


def rebuild(leaves: DataFrame, domains: int) -> DataFrame:
    """(shard, lower, upper) of min(domains, leaves) shards.

    ``leaves`` are (nth from 0, n, upper): shard i ends where leaf (i + 1) * n div
    shards - 1 ends, the last is open.
    """
    shards = F.least(F.lit(domains), F.col("n"))
    i = F.floor((F.col("nth") * shards + shards - 1) / F.col("n"))
    ends = leaves.withColumn("shard", i).filter(F.col("nth") == F.expr("((shard + 1) * n) DIV least({d}, n) - 1".format(d=domains)))
    order = Window.orderBy("shard")
    last = F.col("shard") == shards - 1
    return ends.select(F.col("shard").cast("long"), F.lag("upper").over(order).alias("lower"), F.when(~last, F.col("upper")).alias("upper"))
