"""Dense vector files, encoded write batches, and index artefacts."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes of the operations of an encoded batch; fixed values.
PUT, DEL = 1, 2
_KINDS = {"float": ("<f4", "float"), "ubyte": ("u1", "smallint"), "uint": ("<u4", "long")}


def read_vectors(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """(file, id, v) of files that hold u32 rows, u32 columns, then the rows' numbers; a short file is an error."""
    return decode_vectors(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), kind)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id) of a file of neighbours' ids, a row a query, nearest first; ranks from 1."""
    rows = read_vectors(spark, path, "uint")
    return rows.select(F.col("id").alias("qid"), F.posexplode("v").alias("at", "id")).select("qid", (F.col("at") + 1).alias("rank"), "id")


def decode_vectors(files: DataFrame, kind: str = "float") -> DataFrame:
    """(file, content) -> (file, id, v), numbered from 0 in each file."""
    code, sql = _KINDS[kind]
    name_type = files.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["file"], pdf["content"], strict=True):
                n, dims = np.frombuffer(data, "<u4", 2)
                size = int(n) * int(dims) * np.dtype(code).itemsize
                if len(data) < 8 + size:
                    raise ValueError(f"{name}: {len(data)} bytes, but {n} rows of {dims} are announced")
                x = np.frombuffer(data, code, int(n) * int(dims), 8).reshape(int(n), int(dims))
                for at in range(0, len(x), 10_000):
                    yield pd.DataFrame({"file": name, "id": np.arange(at, min(at + 10_000, len(x))), "v": list(x[at : at + 10_000])})

    return files.select("file", "content").mapInPandas(run, f"file {name_type}, id long, v array<{sql}>")


def vector_file(x: np.ndarray, kind: str = "float") -> bytes:
    """The file's bytes."""
    return struct.pack("<II", *x.shape) + np.ascontiguousarray(x, _KINDS[kind][0]).tobytes()


def vector_blobs(base: DataFrame, files: int, kind: str = "float") -> DataFrame:
    """(file, content): (id, v) striped over ``files`` files, file = id % files, each in id order; a file's rows are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "content": [vector_file(np.stack(pdf["v"].to_list()), kind)]})

    return base.withColumn("file", F.col("id") % files).groupBy("file").applyInPandas(run, "file long, content binary")


def encode_batch(ops: list[tuple[str, str, str | None]]) -> bytes:
    out = [struct.pack("<I", len(ops))]
    for op, key, value in ops:
        k, v = key.encode(), (value or "").encode()
        out.append(struct.pack("<BII", PUT if op == "PUT" else DEL, len(k), len(v)) + k + v)
    return b"".join(out)


def decode_batch(data: bytes) -> list[tuple[int, str, str, str | None]]:
    """(pos, op, key, value); what is cut short, unknown, left over, or a delete with a value is an error."""

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("truncated batch")
        at += n
        return data[at - n : at]

    at, out = 0, []
    (count,) = struct.unpack("<I", take(4))
    for pos in range(count):
        op, nk, nv = struct.unpack("<BII", take(9))
        if op not in (PUT, DEL):
            raise ValueError(f"unknown operation {op}")
        if op == DEL and nv:
            raise ValueError("a delete with a value")
        key, value = take(nk).decode(), take(nv).decode()
        out.append((pos, "PUT" if op == PUT else "DEL", key, value if op == PUT else None))
    if at != len(data):
        raise ValueError("bytes after the batch")
    return out


def encode_batches(ops: DataFrame) -> DataFrame:
    """(batch_id, pos, op, key, value) -> (batch_id, payload)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rows = [(o, k, None if o == "DEL" else v) for o, k, v in zip(pdf["op"], pdf["key"], pdf["value"], strict=True)]
        return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "payload": [encode_batch(rows)]})

    return ops.select("batch_id", "pos", "op", "key", "value").groupBy("batch_id").applyInPandas(run, "batch_id long, payload binary")


def decode_batches(batches: DataFrame) -> DataFrame:
    """(batch_id, payload) -> (batch_id, pos, op, key, value, error); a broken payload gives one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for b, p in zip(pdf["batch_id"], pdf["payload"], strict=True):
                try:
                    rows += [(b, *r, None) for r in decode_batch(bytes(p))]
                except (ValueError, UnicodeDecodeError) as e:
                    rows.append((b, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["batch_id", "pos", "op", "key", "value", "error"])
            yield out.astype({"pos": "Int64"})

    return batches.select("batch_id", "payload").mapInPandas(run, "batch_id long, pos long, op string, key string, value string, error string")


def save_index(index: DataFrame, meta: dict, path: str, devices: int = 1) -> None:
    """Index rows, striped by id over ``devices`` folders and sorted, and one row of metadata."""
    spark = index.sparkSession
    index.withColumn("device", F.col("id") % devices).repartition("device").sortWithinPartitions("id").write.mode("overwrite").partitionBy("device").parquet(f"{path}/nodes")
    spark.createDataFrame([(k, str(v)) for k, v in sorted(meta.items())], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    meta = {r.name: r.value for r in spark.read.parquet(f"{path}/meta").collect()}  # a handful of names
    return spark.read.parquet(f"{path}/nodes").drop("device"), meta
