"""Tables of a data folder, and the change log that the key-value queries read.

The log is made of ``events``: 64 consecutive events are a batch, a batch has one
log sequence number (lsn, from 1), an 'error' event deletes its user's key and any
other event puts ``type:props`` under it. ``seq`` orders all rows.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, GENERATION, FRONTS = 64, 16, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; lets local Python workers find this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, user_id, batch_id, pos, lsn, gen, front, seq, op, value, ts_ms)."""
    e = table(spark, sf_dir, "events")
    batch = F.expr(f"event_id DIV {BATCH}")
    return e.select(
        F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 20, "0")).alias("key"),
        "user_id",
        batch.alias("batch_id"),
        (F.col("event_id") % BATCH).alias("pos"),
        (batch + 1).alias("lsn"),
        F.expr(f"(event_id DIV {BATCH} + 1) DIV {GENERATION}").alias("gen"),
        (F.col("user_id") % FRONTS).alias("front"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "DEL").otherwise("PUT").alias("op"),
        F.when(F.col("event_type") != "error", F.concat_ws(":", "event_type", "props")).alias("value"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        "event_type",
    )
