"""Deterministic key-value workloads, and the state that they must leave behind."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.hashing import crc32c, splitmix64

#: Seeds of the key and operation draws, and of values; fixed values.
KEY_SALT, OP_SALT = 0xC001D00D, 0x9F6ABC3D
ID_FACTOR, GENERATION_FACTOR = 0xD6E8FEB86659FD93, 0xA5A5A5A5A5A5A5A5


@dataclass(frozen=True)
class Workload:
    """``kind``: a (half reads), b (95 % reads), c (reads), update, or del."""

    records: int = 10_000
    operations: int = 10_000
    kind: str = "a"
    value_size: int = 256
    seed: int = 1
    prefix: str = "user"

    def key(self, key_id: str = "key_id") -> F.Column:
        width = max(20, len(str(max(self.records - 1, 0))))
        return F.concat(F.lit(self.prefix), F.lpad(F.col(key_id).cast("string"), width, "0"))

    def keys(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.records).select(F.col("id").alias("key_id")).withColumn("key", self.key())

    def ops(self, spark: SparkSession) -> DataFrame:
        """(op_index, kind, key_id, generation = op_index + 1)."""
        w = self

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                i = pdf["id"].to_numpy().astype(np.uint64)
                seed = np.uint64(w.seed)
                key = i % np.uint64(w.records) if w.kind == "del" else splitmix64(seed ^ np.uint64(KEY_SALT) ^ i) % np.uint64(w.records)
                roll = splitmix64(seed ^ np.uint64(OP_SALT) ^ i) % np.uint64(100)
                reads = {"a": 50, "b": 95, "c": 100, "update": 0, "del": 0}[w.kind]
                kind = np.where(roll < reads, "read", "del" if w.kind == "del" else "update")
                yield pd.DataFrame({"op_index": pdf["id"], "kind": kind, "key_id": key.astype(np.int64), "generation": pdf["id"] + 1})

        return spark.range(self.operations).mapInPandas(draw, "op_index long, kind string, key_id long, generation long")

    def values(self, rows: DataFrame) -> DataFrame:
        """Adds ``value`` to rows with (key_id, generation)."""
        w = self

        def make(key: pd.Series, generation: pd.Series) -> pd.Series:
            with np.errstate(over="ignore"):
                k, g = key.to_numpy().astype(np.uint64), generation.to_numpy().astype(np.uint64)
                state = np.uint64(w.seed) ^ (k * np.uint64(ID_FACTOR)) ^ (g * np.uint64(GENERATION_FACTOR))
            body = []
            for _ in range(-(-w.value_size // 8)):
                state = splitmix64(state)
                body.append(np.stack([(state >> np.uint64(8 * j)) & np.uint64(15) for j in range(8)], 1))
            letters = (np.concatenate(body, 1).astype(np.uint8) + ord("a")) if body else np.zeros((len(k), 0), np.uint8)
            heads = [f"id={a};gen={b};seed={w.seed};" for a, b in zip(k, g, strict=True)]
            return pd.Series([(h + row.tobytes().decode())[: w.value_size] for h, row in zip(heads, letters, strict=True)])

        return rows.withColumn("value", F.pandas_udf(make, "string")("key_id", "generation"))


def expected_state(w: Workload, spark: SparkSession) -> DataFrame:
    """(key_id, kind, generation, value_crc32c) after loading all records (generation 0) and applying the operations in order."""
    writes = w.ops(spark).filter("kind <> 'read'")
    last = writes.groupBy("key_id").agg(F.max_by(F.struct("kind", "generation"), "op_index").alias("w"))
    state = w.keys(spark).join(last, "key_id", "left").select(
        "key_id", F.when(F.col("w.kind") == "del", "tombstone").otherwise("value").alias("kind"), F.coalesce("w.generation", F.lit(0)).cast("long").alias("generation")
    )
    crc = w.values(state.filter("kind = 'value'")).select("key_id", crc32c("value").alias("value_crc32c"))
    return state.join(crc, "key_id", "left")


def phase_stats(ops: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, n_ops, n_found, n_missed): reads are found if their key is in (key_id)."""
    f = found.select("key_id").distinct().withColumn("hit", F.lit(1))
    read = F.col("kind") == "read"
    return ops.join(f, "key_id", "left").groupBy("kind").agg(
        F.count("*").alias("n_ops"), F.count_if(read & F.col("hit").isNotNull()).alias("n_found"), F.count_if(read & F.col("hit").isNull()).alias("n_missed")
    )


def phase_report(ops: DataFrame, found: DataFrame, failed: DataFrame, phase: str, seconds: float, batch: int) -> DataFrame:
    """One row of a phase: operations, batches of ``batch``, acknowledged writes, reads found and missed, errors of both, operations a second.

    ``failed`` has the (op_index) that were answered with an error.
    """
    f, bad = found.select("key_id").distinct().withColumn("hit", F.lit(True)), failed.select("op_index").distinct().withColumn("bad", F.lit(True))
    x = ops.join(f, "key_id", "left").join(bad, "op_index", "left")
    read, fine, hit = F.col("kind") == "read", F.col("bad").isNull(), F.col("hit").isNotNull()
    n = F.count("*")
    return x.agg(
        F.lit(phase).alias("phase"), n.alias("n_ops"), F.count_distinct(F.floor(F.col("op_index") / batch)).alias("n_batches"), F.count_if(~read & fine).alias("n_acked"),
        F.count_if(read & fine & hit).alias("n_found"), F.count_if(read & fine & ~hit).alias("n_missed"), F.count_if(~read & ~fine).alias("n_write_errors"),
        F.count_if(read & ~fine).alias("n_read_errors"), (n / F.lit(seconds)).alias("per_second"),
    )


def differences(state: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys whose state is not what was expected: (key_id, expected, actual)."""
    cols = ("kind", "generation", "value_crc32c")
    e = expected.select("key_id", F.struct(*cols).alias("expected"))
    a = state.select("key_id", F.struct(*cols).alias("actual"))
    return e.join(a, "key_id", "full").filter(~F.col("expected").eqNullSafe(F.col("actual")))
