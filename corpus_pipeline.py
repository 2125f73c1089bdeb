"""A corpus pipeline: quality, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
``run`` writes what a stage returns and reads it back as the next one's input.
All stages but the last return the columns of ``documents``.

Every stage gives no rows for an empty table, treats a null text as empty (the first
rejects it), and takes rows that repeat an id, or have none, as documents of their
own; ties go as the operators say. The first stage rejects what fails the base test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.bpe import encode, tokenizer_files
from siltstone.llm.common import fresh, materialize, small_batches, table
from siltstone.llm.jaccard import link
from siltstone.llm.lines import dedup_lines
from siltstone.llm.mixing import mix
from siltstone.llm.quality import assess


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return assess(docs, carry_text=True).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated windows; a text that loses all its words goes."""
    cut = dedup_lines(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id (without an id last); all others stay.

    Rows that repeat an id, or have none, are documents of their own; they are
    numbered then, and written so that their numbers stay the same.
    """
    row, other = fresh(docs, "_row", "_other")
    unique = docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty()
    if unique:
        named = docs.withColumn(row, F.col("doc_id"))
    else:
        named = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "named")
    with small_batches(spark):
        linked = link(named, doc=row, k=5, num=80, den=100, unique=True).select(F.col("doc_id").alias("at"), F.col("component_id").alias("of"))
    if unique:
        others = linked.filter("at <> of").select(F.col("at").alias(other))
    else:
        members = linked.join(named.select(F.col(row).alias("r"), F.col("doc_id").alias("id")), F.col("at") == F.col("r"))
        members = materialize(members.select("of", "at", F.struct(F.col("id").isNull(), "id", "at").alias("place")), "members")
        first = members.groupBy("of").agg(F.min("place").alias("first")).withColumnRenamed("of", "group")
        others = members.join(first, (F.col("of") == F.col("group")) & ~F.col("place").eqNullSafe(F.col("first"))).select(F.col("at").alias(other))
    return named.join(materialize(others, "others"), F.col(row) == F.col(other), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    (again,) = fresh(docs, "_again")
    return mix(docs).withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): the texts as packed token ids."""
    with small_batches(spark):
        return materialize(encode(docs, *tokenizer_files(), keep=["doc_id", "lang", "source"], decoded=False), "tokens")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixing", mixing),
    ("byte-level BPE", tokens),
]

#: The last stage has no SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
