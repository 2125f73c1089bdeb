"""Point, multi-key and range reads of a versioned log under a snapshot.

Winners are chosen before tombstones are dropped: a delete hides older values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winners(log: DataFrame, *more: str) -> DataFrame:
    """The newest row of each key (by seq): key, lsn, op, value and ``more``. One shuffle, with map-side maxima."""
    cols = ("seq", "lsn", "op", "value", *more)
    best = log.groupBy("key").agg(F.max_by(F.struct(*cols), "seq").alias("w"))
    return best.select("key", *[F.col(f"w.{c}").alias(c) for c in cols if c != "seq"])


def live(won: DataFrame) -> DataFrame:
    return won.filter("op = 'PUT'").drop("op")


@dataclass(frozen=True)
class Snapshot:
    """Reads of an immutable log at one lsn.

    ``read_lsn`` is a number or a one-row frame of one column, which then stays a
    part of the plan. With a base table (one winner a key) the log must reach back
    to its frontier, and reading below that frontier is an error.
    """

    log: DataFrame
    read_lsn: int | DataFrame
    base: DataFrame | None = None
    base_frontier: int = 0

    def rows(self) -> DataFrame:
        if isinstance(self.read_lsn, int):
            if self.base is not None and self.read_lsn < self.base_frontier:
                raise ValueError(f"lsn {self.read_lsn} is below the base's frontier {self.base_frontier}")
            log = self.log.filter(F.col("lsn") <= self.read_lsn)
        else:
            at = self.read_lsn.toDF("_at")
            log = self.log.join(F.broadcast(at), F.col("lsn") <= F.col("_at")).drop("_at")
        if self.base is None:
            return log
        return log.filter(F.col("lsn") > self.base_frontier).unionByName(self.base, allowMissingColumns=True)

    def get(self, key: str) -> DataFrame:
        return live(winners(self.rows().filter(F.col("key") == key)))

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(pos, key) -> (pos, key, found, lsn, value) for every asked key; repeated keys are looked up once."""
        asked = keys.select("key").distinct()
        found = live(winners(self.rows().join(asked, "key", "left_semi")))
        return keys.join(found, "key", "left").select("pos", "key", F.col("lsn").isNotNull().alias("found"), "lsn", "value")

    def scan(self, begin: str | None = None, end: str | None = None, keep_tombstones: bool = False) -> DataFrame:
        """[begin, end); empty when begin >= end. Rows come unsorted; order by key to stream them."""
        rows = self.rows().filter(in_range(begin, end))
        won = winners(rows)
        return won if keep_tombstones else live(won)

    def page(self, after: str | None, n: int) -> DataFrame:
        """The next ``n`` live keys above ``after``, in key order; nothing at the end."""
        rows = self.rows() if after is None else self.rows().filter(F.col("key") > after)
        return live(winners(rows)).orderBy("key").limit(n)


def in_range(begin: str | None, end: str | None) -> Column:
    test = F.lit(True)
    if begin is not None:
        test = test & (F.col("key") >= begin)
    if end is not None:
        test = test & (F.col("key") < end)
    return test


def by_layer(layers: DataFrame) -> DataFrame:
    """Winners over memtable generations and tree (layer 0 first): the newest version, then the nearer layer."""
    order = Window.partitionBy("key").orderBy(F.col("lsn").desc(), "layer")
    return layers.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
