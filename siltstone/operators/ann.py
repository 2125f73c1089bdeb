"""A vector index as artefacts in a folder: built stage by stage, checked when loaded, searched from what is stored.

Artefacts are Parquet tables: ``meta``, ``sample``, ``center`` and ``codebook`` (with
each chunk's offset), ``codes`` (an array a vector), ``nodes`` (striped over devices),
``medoid``, ``centroids`` and ``entries``. A stage whose artefact is complete is not run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.vectors import chunk_offsets
from siltstone.operators import graph, knn, pq
from siltstone.sources.scratch import Files


@dataclass(frozen=True)
class Options:
    """What an index is built with; defaults as usual for graphs of this kind."""

    dims: int
    chunks: int = 16
    codes: int = 256
    sample: int = 50_000
    rounds: int = 12
    degree: int = graph.DEGREE
    size: int = graph.BUILD_LIST
    alpha: float = graph.ALPHA
    entries: int = 8
    devices: int = 1
    shard: int | None = None


@dataclass(frozen=True)
class Index:
    """The loaded artefacts."""

    options: Options
    nodes: DataFrame
    codes: DataFrame
    codebook: DataFrame
    center: DataFrame
    medoid: int
    entries: DataFrame

    def search(self, queries: DataFrame, k: int = 10, size: int = graph.SEARCH_LIST, width: int = graph.BEAM, probes: int = 1) -> DataFrame:
        """(qid, rank, id, dist), from the stored codes; the medoid and the entry points are starts, dealt over the probes."""
        return graph.search(self.nodes, queries, k, size, width, probes, codebook=self.codebook, coded=self.codes, center=self.center, entries=self.entries)


STAGES = ("center", "sample", "codebook", "codes", "nodes", "medoid", "entries", "centroids", "meta")


def build(base: DataFrame, path: str, options: Options) -> list[str]:
    """Build the index of (id, v) under ``path``; the stages that had to run, in order."""
    spark = base.sparkSession
    files, o, ran = Files(spark, path), options, []
    read = lambda name: spark.read.parquet(f"{path}/{name}")

    def stage(name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        if not files.exists(f"{name}/_SUCCESS"):
            writer = make().write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(f"{path}/{name}")
            ran.append(name)
        return read(name)

    center = stage("center", lambda: knn.center(base))
    sample = stage("sample", lambda: knn.sample(base, o.sample))
    at = F.array(*map(F.lit, chunk_offsets(o.dims, o.chunks)))
    trained = lambda: pq.train(pq.chunked(sample, center, o.dims, o.chunks), o.codes, o.rounds)
    codebook = stage("codebook", lambda: trained().withColumn("offset", F.get(at, F.col("chunk"))))
    stage("codes", lambda: packed(pq.encode(pq.chunked(base, center, o.dims, o.chunks), codebook.drop("offset"))))
    nodes = stage("nodes", lambda: _striped(graph.build(base, o.degree, o.size, o.alpha, o.shard), o.devices), "device")
    medoid = stage("medoid", lambda: knn.medoid(base))
    stage("entries", lambda: _entries(nodes, medoid, base, o.entries))
    stage("centroids", lambda: nodes.filter("is_start").select("shard", "id", "v"))
    stage("meta", lambda: _meta(spark, asdict(o) | {"n_vectors": base.count()}))
    return ran


def packed(codes: DataFrame) -> DataFrame:
    """(id, chunk, code) -> (id, codes): a vector's codes by chunk."""
    return codes.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "code"))), lambda c: c["code"]).alias("codes"))


def _striped(nodes: DataFrame, devices: int) -> DataFrame:
    return nodes.withColumn("device", F.col("id") % devices).repartition("device", "shard").sortWithinPartitions("device", "id")


def _entries(nodes: DataFrame, medoid: DataFrame, base: DataFrame, n: int) -> DataFrame:
    """(nth, id): the medoid, then the farthest of what a breadth-first walk from the shards' starts reaches first."""
    edges = nodes.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))
    levels = graph.bfs_levels(edges, nodes.filter("is_start").select("id").unionByName(medoid.select("id")).distinct(), most=2)
    first = medoid.select("id", F.lit(-1).alias("level"))
    return graph.entry_points(base, first.unionByName(levels.join(first.select("id"), "id", "left_anti")), n)


def _meta(spark: SparkSession, values: dict) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sorted(values.items())], "name string, value string").coalesce(1)


def load(spark: SparkSession, path: str) -> Index:
    """The index under ``path``; an artefact that is missing or does not fit the others is an error."""
    files = Files(spark, path)
    missing = [n for n in STAGES if not files.exists(f"{n}/_SUCCESS")]
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    raw = {r.name: r.value for r in read("meta").collect()}  # a handful of names
    kinds = {"alpha": float}
    options = Options(**{k: None if v is None else kinds.get(k, int)(v) for k, v in raw.items() if k != "n_vectors"})
    check_codebook(read("codebook"), options)
    lengths = read("codes").agg(F.min(F.size("codes")).alias("lo"), F.max(F.size("codes")).alias("hi"), F.count("*").alias("n")).first()
    if lengths.n != int(raw["n_vectors"]) or lengths.n and {lengths.lo, lengths.hi} != {options.chunks}:
        raise ValueError(f"{path}: codes are not of {raw['n_vectors']} vectors of {options.chunks} chunks")
    return Index(options, read("nodes").drop("device"), read("codes"), read("codebook").drop("offset"), read("center"), read("medoid").first().id, read("entries").select("id"))


def check_codebook(codebook: DataFrame, options: Options) -> None:
    """A row for each code from 0 of every chunk, no more codes than asked for, offsets and widths that fill the dimensions."""
    at = chunk_offsets(options.dims, options.chunks)
    rows = codebook.groupBy("chunk", "offset").agg(F.count("*").alias("n"), F.count_distinct("code").alias("k"), F.max("code").alias("top"), F.min(F.size("w")).alias("lo"), F.max(F.size("w")).alias("hi")).orderBy("chunk").collect()
    fine = len(rows) == options.chunks and all(
        r.chunk == i and r.offset == at[i] and r.lo == r.hi == at[i + 1] - at[i] and r.n == r.k == r.top + 1 <= options.codes for i, r in enumerate(rows)
    )
    if not fine:
        raise ValueError("the codebook does not fit its metadata")
