"""What the operators share: tables, scratch space, words, streamed key runs.

Scratch tables are Parquet in the folder that ``spark.checkpoint.dir`` names,
which every executor can reach; a lost executor therefore never loses one.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: 0x20 and 0x09 to 0x0D. ``bytes.split()`` cuts at the same.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; lets local Python workers find this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; a local session without one (tests) gets one of its own, a cluster's is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, keeps columns."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` has one."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def numbered(df: DataFrame, doc: str, text: str, unique: bool | None = None) -> tuple[DataFrame, bool]:
    """(id, row, text) with a number for each row, and whether that is its id.

    It is the id if none is null or repeated (``unique``, if that is known). Numbers
    of their own are written with the texts, so that they stay the same.
    """
    docs = df.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    if unique is None:
        unique = docs.groupBy("id").count().filter("id IS NULL OR count > 1").isEmpty()
    if unique:
        return docs.select("id", F.col("id").alias("row"), "text"), True
    return materialize(docs.select("id", F.monotonically_increasing_id().alias("row"), "text"), "numbered"), False


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def trim() -> None:
    """Gives what this Python worker has freed back to the system; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if release is not None:
        release(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with a ``trim`` before and after."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()

    return task


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Python workers get batches of so many rows at most in what runs meanwhile; whole texts make Spark's 10,000 rows large on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(rows, before) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class WordHash(dict):
    """Word -> 64-bit hash, remembered for a bounded number of words (some 45 MB)."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], seen: WordHash) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; a shorter text is one run; no words, none."""
    if not len(w):
        return w
    k, n = min(k, len(w)), len(w) - min(k, len(w)) + 1
    out = w[:n].copy()
    for i in range(1, k):  # words' hashes are spread already, so one mixing at the end will do
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += w[i : n + i]
    return mix64(out)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``df.mapInArrow`` for a function of single batches; None means no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def bounded_batches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        total = np.cumsum(sizes) // most
        start = 0
        for end in [*(np.flatnonzero(np.diff(total)) + 1).tolist(), batch.num_rows]:
            if end > start:
                yield batch.slice(start, end - start)
                start = end


def clean_null(col: str) -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))
