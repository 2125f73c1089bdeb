"""Line dedup by overlapping windows of three lines, with DataFrame functions only.

A text is cut at \\n. Each run of three lines that holds a word is a window, named
by two 64-bit hashes of its lines. Of equal windows the one with the smallest
(id, line number) stays; the lines of all others are removed, overlaps merged.

Defined results: a null text counts as empty; texts of fewer than three lines
keep all of them; rows equal in id and text count as one document, and rows that
share an id with different texts are documents of their own; documents without an
id come after all others, and ties go by a hash of the text; an empty table gives
no rows; other columns are untouched, whatever their names, but ``n_lines`` and
``n_removed`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table


def windows(df: DataFrame, row: list[Column], text: str = "text") -> DataFrame:
    """(id, body, line, h1, h2): the windows of every text; ``row`` makes id and body."""
    three = "get(ls, i), get(ls, i + 1), get(ls, i + 2)"
    found = f"""transform(array(split(`{text}`, '\\n')), ls -> if(size(ls) < 3, array(), filter(transform(sequence(0, size(ls) - 3), i -> struct(
        i AS line, xxhash64({three}) AS h1, xxhash64(7, {three}) AS h2, concat({three}) RLIKE '[^\\\\x20\\\\x09-\\\\x0D]' AS held)), w -> w.held)))[0]"""
    every = df.filter(F.col(text).isNotNull()).select(*row, F.explode(F.expr(found)).alias("w"))
    return every.select("id", "body", "w.line", "w.h1", "w.h2")


def dedup_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with later repeats cut from ``text``, and ``n_lines``, ``n_removed`` added.

    The repeated windows are counted with map-side sums and written; the join
    back then has two plain inputs, so that a hot window's rows can be split. A
    document is joined to its removed lines by a hash of its id and text, which
    also spreads documents without an id.
    """
    own = [F.col(doc).alias("id"), F.xxhash64(F.lit(1), text).alias("body")]
    found = windows(df, own, text)
    place = F.struct(F.col("id").isNull().alias("late"), "id", "body", "line")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = materialize(repeated, "windows")
    later = found.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy(F.xxhash64("id", "body").alias("k"), F.col("body").alias("b")).agg(F.sort_array(F.collect_set("line")).alias("starts"))
    cut = """transform(array(split(txt, '\\n')), ls -> if(starts IS NULL, ls, flatten(zip_with(
        concat(array(-3), starts), concat(starts, array(size(ls))),
        (a, b) -> if(b > a + 3, slice(ls, a + 4, b - a - 3), array())))))[0]"""
    names = [c for c in df.columns if c not in (text, "n_lines", "n_removed")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("txt"), *own)
    joined = rows.join(starts, (F.xxhash64("id", "body") == F.col("k")) & (F.col("body") == F.col("b")), "left")
    kept = joined.withColumn("kept", F.when(F.col("starts").isNotNull(), F.expr(cut)))
    n = F.when(F.col("txt").isNull() | (F.col("txt") == ""), 0).otherwise(F.size(F.split("txt", "\n"))).cast("long")
    left = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.coalesce("txt", F.lit("")))
    gone = F.coalesce(n - F.size("kept"), F.lit(0)).cast("long")
    return kept.select(*[F.col(f"row.`{c}`") for c in names], left.alias(text), n.alias("n_lines"), gone.alias("n_removed"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
