"""Exact Jaccard join of n-gram sets by universe partition.

The universe of shingles is hashed into segments. For a pair whose larger set lies
in a size band, the sets differ in at most H shingles; a band has H + 1 units, and
a segment is one unit, matched whole, or two, matched up to one deletion. By the
pigeonhole principle a linked pair agrees in some segment: its whole subset, or a
subset less one shingle. How many segments of a band are of two units is set by
cost: deletions bring a row a shingle, single units bring chance agreements of
near-empty segments, the more the more sets the band has.

Sets that share a segment key are tested against the first of them, and every
link found joins components. A pair's sketches are compared first: a set's bits are
the parities of its shingles by hash, two sets that differ in d shingles differ in d
bits at most, and only pairs that may still link send their texts. Keys whose sets still lie in several components go
on: the untested pairs of a key of ``FEW`` sets or less are tested one by one, and
the sets of larger keys are compared block by block within tasks that return only
links which join something. A pair is therefore left out only where its two sets
are already in one component.

Defined results: a text without words has no shingles and is linked with nothing;
one with fewer words than a shingle is one shingle; a null text counts as empty; rows
that repeat an id, or have none, are documents of their own, and the component of
documents without any id is null; an empty table gives no rows; other columns are
dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import WordHash, bounded_batches, discard, map_batches, materialize, mix64, numbered, shingle_hashes, shuffle_parts, table, trimmed, word_hashes, words_of
from siltstone.llm.components import components
from siltstone.llm.runs import SCHEMA, led, parts_for, shared

#: Ratio of a size band's ends.
BAND = 1.25
#: Pairs of one leader that are tested in one task.
LEADS = 32
#: Sets of a key up to which its pairs are listed; sets in a block of larger keys' families; shingles in a slab.
FEW, BLOCK, SLAB = 33, 192, 8192
#: Sets of a batch that make a shingle common, and the most common shingles that are told apart.
COMMON, MOST_COMMON = 4, 300_000
#: Cost of a chance pair, in index rows.
PAIR_COST = 300.0


def _tail(mean: float, above: int) -> float:
    """Probability that a Poisson count is larger than ``above``; by the normal law for large means."""
    if mean > 100:
        return math.erfc((above + 0.5 - mean) / math.sqrt(2 * mean)) / 2
    term = total = math.exp(-mean)
    for i in range(1, above + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


class Bands:
    """Size bands; band j has ``units[j]`` units, ``spare[j]`` of them more than must differ.

    A pair agrees in segments of more than ``spare`` units, so a set whose empty
    keys lie in segments of ``spare`` units at most needs none of them. ``double``
    segments are of two units. Spare units and double segments are set by cost.
    """

    def __init__(self, num: int, den: int, counts: dict[int, int], share: float | None = None, common: np.ndarray | None = None):
        self.num, self.den = num, den
        self.common = np.zeros(0, np.uint64) if common is None else np.sort(common)
        self.low = [1]
        while self.low[-1] < 1 << 31:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND)))
        top = [x - 1 for x in self.low[1:]]
        self.units, self.spare, self.double = [], [], []
        for j, u in enumerate(top):
            needed = 2 * u * (den - num) // (den + num) + 1
            sets = counts.get(j, 0) + counts.get(j - 1, 0)
            spare, double = self._allocate(needed, self.low[j], sets) if sets else (0, 0)
            if share is not None:
                double = int((needed + spare) // 2 * share)
            self.units.append(needed + spare)
            self.spare.append(spare)
            self.double.append(double)

    def _allocate(self, needed: int, size: int, sets: int) -> tuple[int, int]:
        """The spare units and double segments that cost least: index rows, and chance pairs by empty keys."""

        def cost(choice: tuple[int, int]) -> float:
            spare, d = choice
            units = needed + spare
            one = size / units
            empty = (units - 2 * d) * math.exp(-one) + 2 * d * math.exp(-2 * one) * (1 + 2 * one)
            pairs = sets / 2 * _tail(empty, spare) ** 2 * empty * math.exp(-one)
            return units - 2 * d + d * (1 + 2 * one) + PAIR_COST * pairs

        mean = needed * math.exp(-size / needed)
        spares = sorted({0, 1, 2, 3, *(math.ceil(mean + k * math.sqrt(mean)) for k in (1, 2, 4, 6))})
        return min(((z, d) for z in spares for d in sorted({0, (needed + z) // 4, (needed + z) // 2})), key=cost)

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size meets sets of its own or a larger band."""
        j = int(np.searchsorted(self.low, size, "right")) - 1
        out = [j]
        while j + 1 < len(self.units) and self.num * self.low[j + 1] <= self.den * size:
            j += 1
            out.append(j)
        return out

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """Segment keys of a set of 64-bit shingle hashes, for all its bands.

        Keys are of the shingles that are not common: sets differ in no more of
        those than of all. A set that more empty keys are left to than it can spare
        gives keys of all its shingles too; where both sets of a pair do, these meet.
        """
        at = np.searchsorted(self.common, tokens)
        rare = tokens[self.common[np.minimum(at, len(self.common) - 1)] != tokens] if len(self.common) else tokens
        out = []
        for j in self.of(len(tokens)):
            enough = self._band_keys(j, rare, 0, out)
            if not enough:
                self._band_keys(j, tokens, 1, out)
        return np.concatenate(out)

    def _band_keys(self, j: int, tokens: np.ndarray, salt: int, out: list[np.ndarray]) -> bool:
        """Adds the keys to ``out``: those of no shingle only to the second kind, and only if needed. Whether none was."""
        units, d = self.units[j], self.double[j]
        unit = ((tokens >> np.uint64(11)) % np.uint64(units)).astype(np.int64)
        seg = np.where(unit < 2 * d, unit >> 1, unit - d) if d else unit
        order = np.argsort(seg, kind="stable")
        value, seg = tokens[order], seg[order]
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        edge = np.searchsorted(seg, np.arange(units - d + 1))
        sums = total[edge[1:]] - total[edge[:-1]]
        held = np.diff(edge)
        tag = mix64((np.arange(units - d, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) + np.uint64(2 * j + salt))
        bare = held == 0
        lonely = held[:d] == 1
        enough = bare[d:].sum() + 2 * bare[:d].sum() + 2 * lonely.sum() <= self.spare[j]
        skip = enough or not salt
        out.append(mix64((sums + tag)[~bare] if skip else sums + tag))
        if d:
            few = int(edge[d])
            own = seg[:few]
            keep = ~lonely[own] if skip else slice(None)
            out.append(mix64((sums[own] - value[:few] + tag[own])[keep]))
        return bool(enough)


def shingle_set(text: str | None, k: int, seen: WordHash) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words_of(text), seen), k))


def sketch(own: np.ndarray) -> bytes:
    """Parities of a set's hashes over their low bits, one to two bits a shingle."""
    bits = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(data: bytes, size: int) -> int:
    """A sketch as a number, folded to so many bytes."""
    x, bits = int.from_bytes(data, "little"), 8 * len(data)
    while bits > 8 * size:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def differ(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, at the shorter one's length: no more than shingles that one set alone has."""
    size = min(len(a), len(b))
    return (_folded(a, size) ^ _folded(b, size)).bit_count()


def _sizes(docs: DataFrame, k: int) -> DataFrame:
    """(id, row, n, sketch, gram): a document's set size and sketch, or, with ``gram``, the n sets of a batch that hold a common shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in bounded_batches(batches, "text", 8 << 20):
            sizes, sketches, sets = [], [], {}
            for text in batch.column(2):
                own = shingle_set(text.as_py(), k, seen)
                sizes.append(len(own))
                sketches.append(sketch(own))
                sets.setdefault(xxhash.xxh3_128_digest(own), own)
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), none], names=names)
            gram, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            gram, n = gram[n >= COMMON], n[n >= COMMON]
            if len(gram):
                none = pa.nulls(len(gram), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(n), pa.nulls(len(gram), pa.binary()), pa.array(gram.view(np.int64))], names=names)

    names = ["id", "row", "n", "sketch", "gram"]
    return docs.select("id", "row", "text").mapInArrow(trimmed(run), "id long, row long, n long, sketch binary, gram long")


#: The place of a row that stands for a whole set, equal to its lead's.
COPY = 1


def _index(docs: DataFrame, k: int, bands: Bands, parts: int) -> DataFrame:
    """Blobs of ``runs``: segment keys at place 0, and sets equal to one of their batch at place ``COPY``."""
    shared_bands = docs.sparkSession.sparkContext.broadcast(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for batch in bounded_batches(batches, "text", 8 << 20):
            first: dict[bytes, int] = {}
            keys, ids, whole = [], [], []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = shingle_set(text.as_py(), k, seen)
                if not len(own):
                    continue
                digest = xxhash.xxh3_128_digest(own)
                if first.setdefault(digest, ident) == ident:
                    got = shared_bands.value.keys(own)  # a key twice counts once
                    keys.append(got)
                    ids.append(np.full(len(got), ident, np.int64))
                whole.append((*np.frombuffer(digest, np.uint64), ident))
            if keys:
                key = np.concatenate(keys)
                yield led(key, key, np.concatenate(ids), np.zeros(len(key), np.int64), parts)
                key, check, ident = (np.array(x) for x in zip(*whole, strict=True))
                yield led(key, check, ident.astype(np.int64), np.full(len(key), COPY, np.int64), parts)

    return docs.mapInArrow(trimmed(run), SCHEMA)


def plausible(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    for end in ("a", "b"):
        own = sizes.select(F.col("row").alias("at"), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
        pairs = pairs.join(own, F.col(end) == F.col("at")).drop("at")
    pairs = pairs.filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        far = np.array([differ(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
        near = far * (den + num) <= (n_a + n_b) * (den - num)
        return pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    return map_batches(pairs, run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with ``den`` * intersection >= ``num`` * union, from (id, text).

    A leader's text is sent once to each of its parts of about ``LEADS`` pairs, so
    that a leader of very many pairs is spread over all tasks.
    """
    parts = shuffle_parts(pairs.sparkSession)
    busy = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > LEADS)
    busy = materialize(busy.select(F.col("a").alias("busy"), F.ceil(F.col("n") / LEADS).alias("parts")), "busy")
    dealt = pairs.join(busy, F.col("a") == F.col("busy"), "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    rows = dealt.select("a", "part", F.col("b").alias("want"), F.lit(1).alias("role"))
    rows = rows.unionByName(dealt.select("a", "part", F.col("a").alias("want"), F.lit(0).alias("role")).distinct())
    sent = rows.join(texts, F.col("want") == F.col("id")).select("a", "part", "role", "id", "text").repartition(parts, "a", "part").sortWithinPartitions("a", "part", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at, lead = WordHash(), None, np.zeros(0, np.uint64)
        for batch in batches:
            a, part, role, ident, text = batch.columns
            found = []
            for i, here in enumerate(zip(a.to_pylist(), part.to_pylist(), strict=True)):
                own = shingle_set(text[i].as_py(), k, seen)
                if role[i].as_py() == 0:
                    at, lead = here, own
                elif here == at and (len(own) * den >= num * len(lead)) and (len(lead) * den >= num * len(own)):
                    both = len(np.intersect1d(own, lead, assume_unique=True))
                    if both and den * both >= num * (len(own) + len(lead) - both):
                        found.append((here[0], ident[i].as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return sent.mapInArrow(trimmed(run), "a long, b long")


def _spanning(sets: list[np.ndarray], ids: list[int], side: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links of two blocks' sets, across them (or within, if they are one): as many as join what all links join.

    Intersections are products of 0/1 matrices over the shingles that two sets have, a slab of them at a time.
    """
    n, sizes, cross = len(sets), np.array([len(x) for x in sets]), len(set(side)) > 1
    token, row = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    token, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    own = count[inverse] > 1
    row, col = row[own], place[inverse[own]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, SLAB):
        x, y = np.searchsorted(col, (start, start + SLAB))
        m = np.zeros((n, SLAB), np.float32)
        m[row[x:y], col[x:y] - start] = 1
        both += m @ m.T
    near = den * both.astype(np.int64) >= num * (sizes[:, None] + sizes - both.astype(np.int64))
    side = np.array(side)
    near &= np.triu(np.ones((n, n), bool), 1) & ((side[:, None] != side) if cross else True)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = root(int(i)), root(int(j))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((ids[i], ids[j]))
    return out


def _families(rows: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links within families: the sets (key, id) that keys of many sets bring together.

    A family is dealt in blocks, and each two blocks meet in one task, which
    returns a spanning part of their links; no pair leaves a task otherwise.
    """
    parts = shuffle_parts(rows.sparkSession)
    first = materialize(rows.groupBy("key").agg(F.min("id").alias("a")).withColumnRenamed("key", "k"), "first")
    family = materialize(components(rows.join(first, F.col("key") == F.col("k")).select("a", F.col("id").alias("b"))), "families")
    blocks = materialize(family.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("component", "of"), "blocks")
    dealt = materialize(family.join(blocks, F.col("component") == F.col("of")).select("of", "node", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "members")
    sent = dealt.join(texts, F.col("node") == F.col("id")).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    sent = sent.select("of", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "text")
    sent = sent.repartition(parts, "of", "i", "j").sortWithinPartitions("of", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at = WordHash(), None
        sets: list[np.ndarray] = []
        ids: list[int] = []
        side: list[int] = []

        def done() -> Iterator[pa.RecordBatch]:
            found = _spanning(sets, ids, side, num, den) if len(sets) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            of, i, j, block, ident, text = batch.columns
            for r, here in enumerate(zip(of.to_pylist(), i.to_pylist(), j.to_pylist(), strict=True)):
                if here != at:
                    yield from done()
                    at, sets, ids, side = here, [], [], []
                sets.append(shingle_set(text[r].as_py(), k, seen))
                ids.append(ident[r].as_py())
                side.append(block[r].as_py())
        yield from done()

    return materialize(sent.mapInArrow(trimmed(run), "a long, b long"), "links")


def link(df: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100, share: float | None = None, unique: bool | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``df``; ``unique`` if its ids are known to be.

    ``share`` sets the part of each band's units that two-unit segments take,
    in place of the costs.
    """
    docs, by_id = numbered(df, doc, text, unique)
    every = materialize(_sizes(docs, k), "sizes")
    sizes = every.filter("gram IS NULL").drop("gram")
    often = every.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(MOST_COMMON).select("gram")
    common = np.array([r.gram for r in often.collect()], np.int64).view(np.uint64)
    edges = Bands(num, den, {}).low
    band = reduce(lambda e, i: e.when(F.col("n") < edges[i + 1], i), range(1, len(edges) - 1), F.when(F.col("n") < edges[1], 0))
    counts = {r.band: r["count"] for r in sizes.filter("n > 0").groupBy(band.alias("band")).count().collect()}  # a row a band
    bands = Bands(num, den, counts, share, common)

    docs = docs.select(F.col("row").alias("id"), "text")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    index = _index(docs.filter("text IS NOT NULL"), k, bands, parts_for(total * 0.4))
    found = materialize(shared(index).select("key", "place", "id", F.col("lead_id").alias("lead")), "index")
    copies = found.filter(F.col("place") == COPY).select(F.col("lead").alias("a"), F.col("id").alias("b"))
    same = materialize(components(copies), "same")
    rows = found.filter("place = 0").drop("place")
    for name in ("id", "lead"):  # equal sets go on as the smallest of their documents
        of = same.select(F.col("node").alias("copy"), F.col("component").alias("whole"))
        rows = rows.join(of, F.col(name) == F.col("copy"), "left").withColumn(name, F.coalesce("whole", name)).drop("copy", "whole")
    rows = materialize(rows, "rows")

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among the pairs; only texts of plausible ones are read."""
        near = materialize(plausible(pairs, sizes, num, den), "near")
        needed = near.select(F.explode(F.array("a", "b")).alias("want")).distinct()
        texts = materialize(docs.join(needed, F.col("id") == F.col("want")).select("id", "text"), "texts")
        out = materialize(verify(near, texts, k, num, den), "links")
        discard(near, texts)
        return out

    tested = materialize(rows.filter("lead <> id").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct(), "tested")
    links = copies.unionByName(linked(tested))
    found = materialize(components(links), "components")
    labelled = rows.select("key", "id").join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    labelled = materialize(labelled.distinct(), "labelled")
    open_keys = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("n > 2 AND lo <> hi")
    open_keys = materialize(open_keys.select(F.col("key").alias("open"), "n"), "open")
    if not open_keys.isEmpty():
        rows = materialize(labelled.join(open_keys, F.col("key") == F.col("open")).drop("open"), "rows")
        few = rows.filter(F.col("n") <= FEW)
        met = few.join(few.select(F.col("key").alias("k"), F.col("id").alias("other"), F.col("component").alias("c")), (F.col("key") == F.col("k")) & (F.col("id") < F.col("other")) & (F.col("component") != F.col("c")))
        fresh = met.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        links = links.unionByName(linked(materialize(fresh, "fresh")))
        links = links.unionByName(_families(rows.filter(F.col("n") > FEW).select("key", "id"), docs, k, num, den))
        found = materialize(components(links), "components")
    own = F.coalesce("component", "row")
    out = sizes.select("id", "row", "n").join(found, F.col("row") == F.col("node"), "left")
    if by_id:  # a component's smallest number is its smallest id then
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))
    least = materialize(out.groupBy(own.alias("of")).agg(F.min("id").alias("least")), "least")
    return out.join(least, own == F.col("of")).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"))
