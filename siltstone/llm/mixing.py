"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Its source takes it when the hash is below the
source's threshold, which is found from histograms of sizes: 4096 buckets of the
hash, then 4096 of the boundary bucket alone, down to one hash. Nothing is
sorted but histograms, and only their few rows meet in one task.

Sources in code-point order (null last) weigh as ``weights``, repeating. They share
``share`` of all sizes; a target stops at ``most`` times its source's size and the
excess goes to the others by weight until none is above.

Documents whose hashes are equal at the boundary (rows that repeat an id, or have
none) are told apart by a hash of the text, and rows equal in both by a number of
their own, so that no group is taken all or none.

Defined results: a null text has size 0; null is a source of its own; sources without
words have the target 0; no document is taken more than ``most`` times; of rows equal
in id and text at the boundary, which ones are taken depends on how the table is
split, how many does not; an empty table gives no rows; other columns are untouched,
whatever their names, but those of the added names are replaced. There is a row for
each source in one task, so sources must be fewer than a task can sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table

BITS, LEVELS = 12, 5


def hash60(doc: str) -> F.Column:
    return F.conv(F.substring(F.sha2(F.coalesce(F.col(doc).cast("string"), F.lit("null")), 256), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """(_source, _size) of documents -> a row for each source with its target.

    In order of size to weight, a source stops at its bound when its share of what
    the smaller ones left is as large; all others get their share of the rest.
    """
    one = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = one.withColumn("_w", w.cast("long")).withColumn("_cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    num, den = share
    budget = F.sum("source_size").over(whole) * num  # times den
    left_w = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0)) * den
    full = ranked.withColumn("_budget", budget).withColumn("_stops", F.col("_cap") * den * left_w <= F.col("_w") * left)
    stopped, running = F.col("_stops"), ~F.col("_stops")
    rest = F.col("_budget") - F.coalesce(F.sum(F.when(stopped, F.col("_cap"))).over(whole), F.lit(0)) * den
    rest_w = F.sum(F.when(running, F.col("_w"))).over(whole)
    target = F.when(stopped, F.col("_cap").cast("double")).otherwise((rest * F.col("_w")).cast("double") / (rest_w * den).cast("double"))
    return full.withColumn("target", target).select("_source", "source_size", "target")


def boundaries(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(source, size, hash) and (s, budget, taken) -> adds to state ``cut``, ``end``, ``sum``, ``n``, or nulls.

    ``cut`` is the smallest hash at which a source's sizes, added in the order of
    hashes to ``taken``, pass its budget; ``end`` is their sum up to it, ``sum`` and
    ``n`` those of the cut alone. A level's histogram holds only what shares the
    boundary bucket of the level before; the rows of the first one are written.
    """
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.col("taken").cast("long"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        near = rows.join(state, F.col("source").eqNullSafe(F.col("s"))).filter(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        if level == 2:
            rows = materialize(near.select("source", "size", "hash"), "boundary")
            near = rows.join(state, F.col("source").eqNullSafe(F.col("s")))
        histogram = near.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        up_to = Window.partitionBy("source").orderBy("bucket")
        cut = (
            histogram.withColumn("end", F.sum("sum").over(up_to))
            .join(state.select(F.col("s").alias("t"), "budget", F.col("before").alias("b")), F.col("source").eqNullSafe(F.col("t")))
            .withColumn("end", F.col("end") + F.col("b"))
            .filter(F.col("end") > F.col("budget"))
            .groupBy("source").agg(F.min(F.struct("bucket", "end", "sum", "n")).alias("c"))
        )
        state = state.select(*[c for c in state.columns if c not in ("cut", "end", "sum", "n")]).join(cut, F.col("s").eqNullSafe(F.col("source")), "left").drop("source")
        state = state.withColumns({"cut": F.col("c.bucket"), "end": F.col("c.end"), "sum": F.col("c.sum"), "n": F.col("c.n")}).drop("c")
        state = state.withColumn("before", F.coalesce(F.col("end") - F.col("sum"), F.col("before"))).withColumn("prefix", F.coalesce("cut", F.shiftleft("prefix", BITS)))
        state = materialize(state, "mix")
    return state.drop("prefix", "before")


def mix(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Adds ``size`` (words), ``source_size``, ``target`` (the source's), ``times`` (takings of the document) and ``taken`` (words taken, repeats counted)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    own = [c for c in df.columns if c not in ("size", "source_size", "target", "times", "taken")]
    body = F.shiftrightunsigned(F.xxhash64(F.lit(7), text), 4)
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(source).alias("source"), size.alias("size"), hash60(doc).alias("hash"), body.alias("body"))
    narrow = materialize(docs.select("source", "size", "hash", "body"), "sizes")
    state = targets(narrow.select(F.col("source").alias("_source"), F.col("size").alias("_size")), weights, share, most).withColumnRenamed("_source", "s")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = state.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    state = boundaries(narrow, materialize(state.withColumn("taken", F.lit(0).cast("long")), "mix"))
    # the row at the boundary is taken if that comes closer to the budget
    closer = F.coalesce(F.col("end") - F.col("budget") < F.col("budget") - (F.col("end") - F.col("sum")), F.lit(False))
    below = F.coalesce(F.col("cut") + F.when(closer, 1).otherwise(0), F.lit(0))
    held = state.select("s", "source_size", "target", "rounds", "cut", below.alias("below"))
    many = state.filter("n > 1")
    out = docs.join(held, F.col("source").eqNullSafe(F.col("s")))
    times = F.least(F.col("rounds") + (F.col("hash") < F.col("below")).cast("long"), F.lit(most))
    if not many.isEmpty():
        groups = many.select("s", "budget", (F.col("end") - F.col("sum")).alias("taken"), F.col("cut").alias("c"))
        tied = out.join(groups.select(F.col("s").alias("g"), "c"), F.col("source").eqNullSafe(F.col("g")) & (F.col("hash") == F.col("c")))
        tied = materialize(tied.withColumn("number", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)).drop("g", "c", "s"), "tied")
        first = boundaries(tied.select("source", "size", F.col("body").alias("hash")), materialize(groups.drop("c"), "mix"))
        first = first.select("s", "budget", (F.col("end") - F.col("sum")).alias("taken"), F.col("cut").alias("body_cut"))
        equal = tied.join(first.select(F.col("s").alias("g"), "body_cut"), F.col("source").eqNullSafe(F.col("g")) & (F.col("body") == F.col("body_cut")))
        second = boundaries(equal.select("source", "size", F.col("number").alias("hash")), materialize(first, "mix"))
        number_below = F.coalesce(F.col("cut") + F.when(closer, 1).otherwise(0), F.lit(0))
        last = second.select(F.col("s").alias("g"), F.coalesce("body_cut", F.lit(1 << 60)).alias("body_cut"), number_below.alias("number_below"))
        taken = (F.col("body") < F.col("body_cut")) | ((F.col("body") == F.col("body_cut")) & (F.col("number") < F.col("number_below")))
        tied = tied.join(last, F.col("source").eqNullSafe(F.col("g"))).withColumn("times", F.least(F.col("rounds") + taken.cast("long"), F.lit(most)))
        alone = out.join(groups.select(F.col("s").alias("g"), "c"), F.col("source").eqNullSafe(F.col("g")), "left").filter("c IS NULL OR hash <> c").withColumn("times", times)
        names = ["row", "size", "source_size", "target", "times"]
        out = alone.select(*names).unionByName(tied.select(*names))
    else:
        out = out.withColumn("times", times)
    return out.select(*[F.col(f"row.`{c}`") for c in own], "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
