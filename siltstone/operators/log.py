"""Write batches and the visibility of their log sequence numbers (lsn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonicalize(ops: DataFrame, batch: str = "batch_id", key: str = "key", pos: str = "pos") -> DataFrame:
    """The last operation on each key of a batch; survivors keep their positions."""
    last = Window.partitionBy(batch, key).orderBy(F.col(pos).desc())
    return ops.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")


def dense_numbers(df: DataFrame, column: str, out: str, width: int = 65536) -> DataFrame:
    """Numbers from 1 without gaps, in the order of a whole-number column of distinct values.

    Rows are counted by ranges of ``width`` values; only the ranges' counts are
    summed in one place, and rows are numbered within their range.
    """
    ranged = df.withColumn("_range", F.floor(F.col(column) / width))
    sums = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(sums), F.lit(0))).drop("_n")
    within = Window.partitionBy("_range").orderBy(column)
    return ranged.withColumn("_nth", F.row_number().over(within)).join(before, "_range").withColumn(out, F.col("_before") + F.col("_nth")).drop("_range", "_nth", "_before")


def durable_prefix(resolved: DataFrame, lsn: str = "lsn") -> DataFrame:
    """One row: the largest n such that 1 to n are all resolved (published or released); 0 if 1 is not.

    The smallest resolved lsn, or 0, without a successor: an anti join and a
    minimum, so that no sort of all lsn is needed.
    """
    spark = resolved.sparkSession
    have = resolved.select(F.col(lsn).alias("n")).distinct()
    starts = have.unionByName(spark.range(1).select(F.lit(0).cast(have.schema["n"].dataType).alias("n")))
    ends = starts.join(have.select((F.col("n") - 1).alias("n")), "n", "left_anti")
    return ends.agg(F.min("n").alias("durable_lsn"))


def gated_prefix(resolved: DataFrame, closed_from: Column, open_again: Column, lsn: str = "lsn") -> DataFrame:
    """The durable prefix as readers see it while publishing is closed for lsn in [closed_from, open_again)."""
    d = F.col("durable_lsn")
    return durable_prefix(resolved, lsn).withColumn("visible_lsn", F.when((d >= closed_from) & (d < open_again), closed_from - 1).otherwise(d))


def visible(log: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of published batches within the durable prefix; a released batch only fills its hole."""
    durable = durable_prefix(status.filter("status <> 'pending'"))
    published = status.filter("status = 'published'").select("lsn")
    return log.join(published, "lsn", "left_semi").join(F.broadcast(durable), F.col("lsn") <= F.col("durable_lsn")).drop("durable_lsn")


def safe_lsn(flushed: DataFrame, unreclaimed: DataFrame) -> DataFrame:
    """One row: min(flush frontier, oldest unreclaimed log record - 1)."""
    frontier = flushed.agg(F.max("lsn").alias("frontier"))
    oldest = unreclaimed.agg(F.min("lsn").alias("oldest"))
    return frontier.crossJoin(oldest).select(F.least("frontier", F.col("oldest") - 1).alias("safe_lsn"))
