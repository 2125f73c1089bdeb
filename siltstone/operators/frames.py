"""Frames around log entries, and why a frame is refused.

A frame is a mark, the generation, the body's length and its CRC-32, as big-endian
numbers of 4, 8, 4 and 4 bytes, and the body. All by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "53494C54"
HEAD = 20


def _number(n: Column, digits: int) -> Column:
    return F.unhex(F.lpad(F.hex(n), digits, "0"))


def frame(df: DataFrame, body: str, generation: str) -> DataFrame:
    """Adds ``frame``."""
    b = F.col(body)
    return df.withColumn("frame", F.concat(F.unhex(F.lit(MARK)), _number(F.col(generation).cast("long"), 16), _number(F.length(b).cast("long"), 8), _number(F.crc32(b), 8), b))


def _field(data: Column, start: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, start, n)), 16, 10).cast("long")


def status(data: Column, generation: Column) -> Column:
    """ok, zero (no byte is set), bad_magic, bad_gen, truncated (shorter than it says, or than a head) or bad_crc; null is zero."""
    length = _field(data, 13, 4)
    body = F.substring(data, F.lit(HEAD + 1), length.cast("int"))
    return (
        F.when(data.isNull() | F.hex(data).rlike("^0*$"), "zero")
        .when(F.hex(F.substring(data, 1, 4)) != MARK, "bad_magic")
        .when((F.length(data) < HEAD) | (F.length(data) < length + HEAD), "truncated")
        .when(_field(data, 5, 8) != generation, "bad_gen")
        .when(F.crc32(body) != _field(data, 17, 4), "bad_crc")
        .otherwise("ok")
    )


def trusted(df: DataFrame, data: str, generation: Column, segment: str, pos: str) -> DataFrame:
    """Entries of each segment before its first that is refused: a zero tail ends it, anything else tears it."""
    judged = df.withColumn("status", status(F.col(data), generation))
    bad = judged.filter("status <> 'ok'").groupBy(F.col(segment).alias("torn")).agg(F.min(pos).alias("bad_pos"))
    return judged.join(bad, F.col(segment) == F.col("torn"), "left").filter((F.col("bad_pos").isNull()) | (F.col(pos) < F.col("bad_pos"))).drop("torn", "bad_pos", "status")
