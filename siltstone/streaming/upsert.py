"""The change log as a stream: newest value of each key, and the durable frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.operators.log import durable_prefix
from siltstone.sources.scratch import Files, fresh_dir


def _drain(frame: DataFrame, schema: StructType) -> DataFrame:
    """Run a stream over all that is there now; each micro-batch writes the whole result to a folder, the last one counts."""
    spark = frame.sparkSession
    path = fresh_dir(spark, "drained")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n:06d}")

    frame.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}.checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = [n for n in Files(spark, path).names() if n.startswith("batch=")][-1:]
    return spark.read.schema(schema).parquet(f"{path}/{last[0]}") if last else spark.createDataFrame([], schema)


def latest_values(changes: DataFrame) -> DataFrame:
    """Streaming (key, seq, lsn, op, value): the newest row of each key, kept as native aggregation state."""
    return changes.groupBy("key").agg(F.max_by(F.struct("lsn", "op", "value"), "seq").alias("w")).select("key", "w.lsn", "w.op", "w.value")


def upsert_latest(changes: DataFrame) -> DataFrame:
    """Final live rows after draining a change stream; tombstones go after the winner is chosen."""
    latest = latest_values(changes)
    return _drain(latest, latest.schema).filter("op = 'PUT'").drop("op")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Streaming counts of operations by event-time window; rows later than ``late`` are dropped."""
    w = events.withWatermark("at", late).groupBy(F.window("at", width), "op").agg(F.count("*").alias("n"))
    return w.select(F.unix_millis("window.start").alias("window_ms"), "op", "n")


def drain_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    counts = windowed_counts(events, width)
    return _drain(counts, counts.schema)


def commit_batches(changes: DataFrame, path: str) -> None:
    """Append each micro-batch as one data folder and then its marker: readers see whole batches only."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={n}")
        batch.groupBy("lsn").count().write.mode("overwrite").parquet(f"{path}/commit/batch={n}")

    changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of committed batches within the durable prefix of their lsn."""
    marks = spark.read.parquet(f"{path}/commit")
    durable = durable_prefix(marks)
    rows = spark.read.parquet(f"{path}/data").join(marks.select("batch").distinct(), "batch", "left_semi")
    return rows.join(F.broadcast(durable), F.col("lsn") <= F.col("durable_lsn")).drop("durable_lsn", "batch")
