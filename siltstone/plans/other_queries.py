"""Workload and streaming queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.kv_queries import LOG, WON
from siltstone.plans.workload import Workload, differences, expected_state, phase_report, phase_stats
from siltstone.sources.tables import change_log
from siltstone.streaming.upsert import drain_windows, upsert_latest

W = Workload(records=1000, operations=4000, kind="a", value_size=64)


def ycsb_keys(s: SparkSession, d: str) -> DataFrame:
    return W.keys(s)


def ycsb_ops(s: SparkSession, d: str) -> DataFrame:
    return W.ops(s)


def ycsb_expected_state(s: SparkSession, d: str) -> DataFrame:
    return expected_state(W, s)


def ycsb_phase_stats(s: SparkSession, d: str) -> DataFrame:
    """Keys below 900 are loaded."""
    return phase_stats(W.ops(s), W.keys(s).filter("key_id < 900"))


def ycsb_phase_report(s: SparkSession, d: str) -> DataFrame:
    """Runs of the workload's kinds; keys below 900 are loaded, every 50th operation fails, a phase takes two seconds."""
    out = None
    for kind in ("a", "b", "c", "update"):
        ops = Workload(records=1000, operations=4000, kind=kind, value_size=64).ops(s)
        one = phase_report(ops, W.keys(s).filter("key_id < 900"), ops.filter("op_index % 50 = 0"), kind, 2.0, 64)
        out = one if out is None else out.unionByName(one)
    return out


def ycsb_differences(s: SparkSession, d: str) -> DataFrame:
    """What a run that missed its last 100 operations got wrong."""
    short = Workload(records=1000, operations=3900, kind="a", value_size=64)
    return differences(expected_state(short, s), expected_state(W, s)).select("key_id", "expected.generation")


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    import os

    local = path.removeprefix("file://")
    glob = f"{d}/{name}.parque[t]" if os.path.isfile(local) else path
    return s.readStream.schema(s.read.parquet(path).schema).parquet(glob)


class _Streamed:
    """A session whose tables are streams, for ``change_log``."""

    def __init__(self, s: SparkSession):
        self.spark, self.sparkContext = s, s.sparkContext
        self.read = self

    def parquet(self, path: str) -> DataFrame:
        folder, name = path.rsplit("/", 1)
        return _stream(self.spark, folder, name.removesuffix(".parquet"))


def stream_upsert_latest(s: SparkSession, d: str) -> DataFrame:
    return upsert_latest(change_log(_Streamed(s), d))


def stream_windows(s: SparkSession, d: str) -> DataFrame:
    c = change_log(_Streamed(s), d)
    return drain_windows(c.select(F.timestamp_millis("ts_ms").alias("at"), "op"))


QUERIES = {f.__name__: f for f in (ycsb_keys, ycsb_ops, ycsb_expected_state, ycsb_phase_stats, ycsb_phase_report, ycsb_differences, stream_upsert_latest, stream_windows)}

_MOD = "18446744073709551616::UHUGEINT"


def _mix(x: str) -> str:
    """SQL of splitmix64 by steps in one row: list_reduce carries the value through."""
    step1 = f"(({x} + 11400714819323198485::UHUGEINT) % {_MOD})"
    a = "(xor(z, z >> 30) * 13787848793156543929::UHUGEINT % {m})".format(m=_MOD)
    b = "(xor(z, z >> 27) * 10723151780598845931::UHUGEINT % {m})".format(m=_MOD)
    c = "xor(z, z >> 31)"
    return f"list_transform(list_transform(list_transform([{step1}], lambda z: {a}), lambda z: {b}), lambda z: {c})[1]"


_OPS = f"""o AS (SELECT i AS op_index, {_mix("xor(xor(1::UHUGEINT, 3221344269::UHUGEINT), i::UHUGEINT)")} % 1000 AS k, {_mix("xor(xor(1::UHUGEINT, 2674572349::UHUGEINT), i::UHUGEINT)")} % 100 AS roll FROM range({W.operations}) r(i)),
ops AS (SELECT op_index, CASE WHEN roll < 50 THEN 'read' ELSE 'update' END AS kind, k::BIGINT AS key_id, op_index + 1 AS generation FROM o)"""

SQL = {
    "ycsb_keys": "SELECT i AS key_id, 'user' || lpad(i::VARCHAR, 20, '0') AS key FROM range(1000) r(i)",
    "ycsb_ops": f"WITH {_OPS} SELECT * FROM ops",
    "ycsb_phase_stats": f"WITH {_OPS} SELECT kind, count(*) AS n_ops, count(*) FILTER (kind = 'read' AND key_id < 900) AS n_found, count(*) FILTER (kind = 'read' AND key_id >= 900) AS n_missed FROM ops GROUP BY kind",
    "ycsb_phase_report": f"""WITH {_OPS}, k AS (SELECT unnest(['a', 'b', 'c', 'update']) AS phase, unnest([50, 95, 100, 0]) AS reads),
x AS (SELECT phase, op_index, key_id, roll < reads AS read, op_index % 50 = 0 AS bad FROM (SELECT op_index, roll, k::BIGINT AS key_id FROM o), k)
SELECT phase, count(*) AS n_ops, count(DISTINCT op_index // 64) AS n_batches, count(*) FILTER (NOT read AND NOT bad) AS n_acked, count(*) FILTER (read AND NOT bad AND key_id < 900) AS n_found,
  count(*) FILTER (read AND NOT bad AND key_id >= 900) AS n_missed, count(*) FILTER (NOT read AND bad) AS n_write_errors, count(*) FILTER (read AND bad) AS n_read_errors, count(*) / 2.0::DOUBLE AS per_second FROM x GROUP BY phase""",
    "ycsb_differences": f"WITH {_OPS} SELECT key_id, max(generation) AS generation FROM ops WHERE kind = 'update' GROUP BY key_id HAVING max(generation) > 3900",
    "stream_upsert_latest": f"WITH {LOG}, w AS (SELECT *, {WON} FROM chg) SELECT key, lsn, value FROM w WHERE nth = 1 AND op = 'PUT'",
    "stream_windows": f"WITH {LOG} SELECT ts_ms // 3600000 * 3600000 AS window_ms, op, count(*) AS n FROM chg GROUP BY 1, 2",
}
