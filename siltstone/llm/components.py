"""Connected components of a table of links, by alternating large and small stars.

Every round replaces each node's links by links to its smallest neighbour; the
rounds end when nothing changes, after about the logarithm of the longest path.
Minima are summed on the map side and written before they are joined back, so
that the rows of a node with many links can be split over tasks. ``SMALL`` links or
fewer are joined by one task instead, as rounds would cost more than the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, materialize


#: Links that one task joins.
SMALL = 10_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of a few links (u, v), by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = sorted(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("h")).first()
    return r.n, r.h or 0


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): each linked node and the smallest node it reaches.

    Loops and null ends are ignored; no links give no rows.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(edges)
    if state[0] <= SMALL:
        return edges.select("u", "v").coalesce(1).mapInArrow(_joined, "node long, component long")
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")), "low")
        large = both.join(low, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        discard(low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"), "low")
        small = large.join(low, F.col("u") == F.col("x")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, edges = edges, materialize(small.unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        discard(done, large, low)
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
