"""Removal of every byte covered by a long string that starts twice, by prefix-free parsing.

A rolling hash of ``WINDOW`` bytes triggers phrase starts, so that equal bytes are
cut alike wherever they stand. The dictionary holds hashes of what follows a
trigger, the parse the places of the triggers. What suffix arrays of dictionary
and parse would show, whether two places go on alike for so many bytes, is read
from sorted hashes: equal continuations lie side by side, and only they matter.

Of a string of ``length`` bytes, let the anchor be its first trigger, if it is
among the first ``reach`` bytes (the string is free otherwise, and so are all its
copies). All strings of one anchor form a group. Three sorts decide:

1. by the ``length - reach`` bytes from a trigger, which every string of the group
   holds; free strings are sorted here too, each by itself;
2. where those repeat, by all bytes of the group's strings: inside repeated
   passages groups are cut alike, and the whole group repeats;
3. where that does not, string by string, with one group of each repeated content
   of sort 2 that shares its bytes of sort 1 as partner.

Equality is that of three polynomial hashes, of 64 + 31 + 31 bits, of which 96 are
compared. The two modulo primes hold where the one modulo 2^64 is weak by its
algebra, as on strings that double and complement themselves.

Defined results: a null text counts as empty; texts shorter than ``length`` keep
all bytes; rows that repeat an id, or have none, are documents of their own; an empty
table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, materialize, mix64, numbered, table
from siltstone.llm.runs import SCHEMA, led, parts_for, shared

#: Bytes of a trigger; one place in ``EVERY`` is one.
WINDOW, EVERY = 12, 48
#: Added to the places of free strings, which are no triggers.
FREE = 1 << 40
#: The hashes: modulus (0 is 2^64), base, seed of the byte values.
_HASHES = ((0, 0x9E3779B97F4A7C15 | 1, 17), (2**31 - 1, 1_103_515_245, 29), (2**31 - 19, 1_566_083_941, 43))


@lru_cache(maxsize=3)
def _values(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


class _Powers:
    """Powers of a base by a modulus, as many as were asked for."""

    def __init__(self, modulus: int, base: int):
        self.modulus, self.base, self.own = modulus, base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.own) < n:
            k = len(self.own)
            step = np.uint64(pow(self.base, k, self.modulus or 1 << 64))
            more = self.own * step
            self.own = np.concatenate([self.own, more % np.uint64(self.modulus) if self.modulus else more])
        return self.own[:n]


_UP = [_Powers(m, b) for m, b, _ in _HASHES]
_DOWN = [_Powers(m, pow(b, -1, m or 1 << 64)) for m, b, _ in _HASHES]


class Parse:
    """A text's bytes with the hashes of any stretch, and its groups of strings."""

    def __init__(self, data: bytes, length: int):
        self.data = np.frombuffer(data, np.uint8)
        n = self.n = len(data)
        self.length, self.reach = length, length * 7 // 10
        self.inner = length - self.reach
        self.sums = [self._sums(0)]
        w, every = min(WINDOW, self.inner), max(2, EVERY * length // 400)
        last = n - w
        if last >= 0:
            h = mix64((self.sums[0][w:] - self.sums[0][: last + 1]) * _DOWN[0](last + 1))
            self.triggers = np.flatnonzero(h % np.uint64(every) == 0)
        else:
            self.triggers = np.zeros(0, np.int64)
        t = self.triggers
        before = np.concatenate([[-1], t[:-1]]) if len(t) else t
        self.low = np.maximum(before + 1, t - self.reach)
        self.high = np.minimum(t, n - length)

    def _sums(self, i: int) -> np.ndarray:
        """Sums of the bytes' values times powers, from the text's start to each place."""
        modulus, _, seed = _HASHES[i]
        values = _values(seed)
        x = (values % np.uint64(modulus) if modulus else values)[self.data] * _UP[i](self.n)
        out = np.zeros(self.n + 1, np.uint64)
        np.cumsum(x % np.uint64(modulus) if modulus else x, out=out[1:])
        return out

    def hashes(self, start: np.ndarray, end: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the bytes from start to end; tag and length go in too."""
        self.sums += [self._sums(i) for i in range(len(self.sums), len(_HASHES))]
        salt = mix64((end - start).astype(np.uint64) * np.uint64(8) + np.uint64(tag))
        out = []
        for (modulus, _, _), s, down in zip(_HASHES, self.sums, _DOWN, strict=True):
            x = s[end] - s[start]
            x = (x % np.uint64(modulus) if modulus else x) * down(self.n + 1)[start]
            out.append(x % np.uint64(modulus) if modulus else x)
        whole, first, second = out
        return mix64(mix64(whole + salt) + (first << np.uint64(31) | second)), mix64((second << np.uint64(32) | first) + salt)

    def groups(self) -> np.ndarray:
        """Places (in ``triggers``) of the anchors of some string."""
        return np.flatnonzero(self.low <= self.high)

    def free(self) -> np.ndarray:
        """Starts of the strings without a trigger among their first ``reach`` bytes."""
        if self.n < self.length:
            return np.zeros(0, np.int64)
        start = np.concatenate([[0], self.triggers + 1])
        end = np.minimum(np.append(self.triggers - self.reach, self.n - self.length + 1), self.n - self.length + 1)
        size = np.maximum(end - start, 0)
        return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())

    def strings(self, at: np.ndarray) -> np.ndarray:
        """Starts of all strings of the groups at these places."""
        size = self.high[at] - self.low[at] + 1
        return np.repeat(self.low[at] - np.cumsum(size) + size, size) + np.arange(size.sum())


def _rows(parts: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]]) -> list[np.ndarray]:
    key, check, ident, place = ([p[i] for p in parts] for i in range(4))
    return [np.concatenate(key), np.concatenate(check), np.repeat(np.array(ident, np.int64), [len(x) for x in place]), np.concatenate(place).astype(np.int64)]


def _first_sort(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """Rows of anchors (place = trigger) and free strings (place = FREE + start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text", 8 << 20):
            anchors, free = [], []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p = Parse(text.as_py().encode("utf-8", "surrogatepass"), length)
                t = p.triggers[p.groups()]
                if len(t):
                    anchors.append((*p.hashes(t, t + p.inner, 1), ident, t))
                f = p.free()
                if len(f):
                    free.append((*p.hashes(f, f + length, 2), ident, f + FREE))
            if anchors:
                yield led(*_rows(anchors), parts)
            if free:
                yield led(*_rows(free), parts, stretch=True)

    return docs.mapInArrow(run, SCHEMA)


def _strings_of(docs: DataFrame, length: int, parts: int, whole: bool) -> DataFrame:
    """Rows of the groups whose triggers are in ``at``: one a group (sort 2) or one a string (sort 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text", 8 << 20):
            rows = []
            for ident, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                p = Parse(text.as_py().encode("utf-8", "surrogatepass"), length)
                g = np.searchsorted(p.triggers, np.unique(at.values.to_numpy(zero_copy_only=False)))
                if whole:
                    rows.append((*p.hashes(p.low[g], p.high[g] + length, 3), ident, p.triggers[g]))
                else:
                    s = p.strings(g)
                    rows.append((*p.hashes(s, s + length, 4), ident, s))
            if rows:
                yield led(*_rows(rows), parts)

    return docs.mapInArrow(run, SCHEMA)


def _removal(docs: DataFrame, length: int) -> DataFrame:
    """(id, text, groups, starts) -> (id, n_bytes, n_removed, n_spans, kept).

    ``groups`` are triggers whose whole groups repeat, ``starts`` (from, to) of repeated strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text", 8 << 20):
            out = []
            for ident, text, groups, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                p = Parse(text.as_py().encode("utf-8", "surrogatepass"), length)
                g = np.searchsorted(p.triggers, groups.values.to_numpy(zero_copy_only=False)) if groups.is_valid else np.zeros(0, np.int64)
                s = starts.values if starts.is_valid else None
                begin, end = [p.low[g]], [p.high[g] + length]
                if s is not None:
                    begin.append(s.field("a").to_numpy(zero_copy_only=False))
                    end.append(s.field("b").to_numpy(zero_copy_only=False) + length)
                depth = np.zeros(p.n + 1, np.int64)
                np.add.at(depth, np.concatenate(begin).astype(np.int64), 1)
                np.add.at(depth, np.concatenate(end).astype(np.int64), -1)
                gone = np.cumsum(depth)[: p.n] > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((ident, p.n, int(gone.sum()), spans, p.data[~gone].tobytes()))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(df: DataFrame, doc: str = "doc_id", text: str = "text", length: int = 400, outputs: Callable[[Column], list[Column]] = lambda kept: [kept.alias("kept")]) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans) and ``outputs`` of the remaining bytes, for each row.

    ``outputs`` are made before texts that nothing is removed from are joined, so
    that a digest travels in place of them.
    """
    every = numbered(df, doc, text)[0].select("id", "row", F.coalesce("text", F.lit("")).alias("text"))
    docs = every.select(F.col("row").alias("id"), "text")
    size = every.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(size / 40 * 400 / length)
    first = materialize(shared(_first_sort(docs, length, parts)).select("key", "id", "place", "until"), "parse")
    anchors = first.filter(F.col("place") < FREE).select("key", "id", F.col("place").alias("at")).distinct()
    free = first.filter(F.col("place") >= FREE).select("id", (F.col("place") - FREE).alias("a"), (F.col("until") - FREE).alias("b"))

    listed = first.groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("place") < FREE, F.col("place")))).alias("at"))
    texts = materialize(docs.join(listed.withColumnRenamed("id", "want"), F.col("id") == F.col("want")).select("id", "text", "at"), "texts")

    second = shared(_strings_of(texts.filter("size(at) > 0"), length, parts, True))
    second = materialize(second.select("id", F.col("place").alias("at"), F.expr("id = lead_id AND place = lead_place").alias("leads")).distinct(), "groups")
    state = anchors.join(second, ["id", "at"], "left").select("key", "id", "at", "leads").filter("leads IS NULL OR leads")
    state = materialize(state, "anchors")
    unsure = state.filter("leads IS NULL")
    asked = unsure.select(F.col("key").alias("asked")).distinct()
    partners = state.filter("leads").join(asked, F.col("key") == F.col("asked"), "left_semi")
    single = unsure.select("id", "at").unionByName(partners.select("id", "at"))
    single = single.groupBy("id").agg(F.collect_set("at").alias("at")).withColumnRenamed("id", "want")
    third = shared(_strings_of(texts.drop("at").join(single, F.col("id") == F.col("want")).select("id", "text", "at"), length, parts, False))
    starts = free.unionByName(third.select("id", F.col("place").alias("a"), F.col("place").alias("b")))

    groups = second.groupBy("id").agg(F.collect_set("at").alias("groups")).withColumnRenamed("id", "group_id")
    starts = starts.groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("starts")).withColumnRenamed("id", "start_id")
    hit = texts.drop("at").join(groups, F.col("id") == F.col("group_id"), "left").join(starts, F.col("id") == F.col("start_id"), "left")
    hit = hit.filter("groups IS NOT NULL OR starts IS NOT NULL").select("id", "text", "groups", "starts")
    hit = _removal(hit, length).select(F.col("id").alias("hit_id"), F.col("n_removed").alias("cut"), F.col("n_spans").alias("cuts"), F.struct(*outputs(F.col("kept"))).alias("new"))

    whole = F.col("text").cast("binary")
    same = every.select("id", "row", F.length(whole).cast("long").alias("n_bytes"), F.struct(*outputs(whole)).alias("old"))
    out = same.join(hit, F.col("row") == F.col("hit_id"), "left")
    made = F.when(F.col("hit_id").isNotNull(), F.col("new")).otherwise(F.col("old")).alias("made")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", F.coalesce("cut", zero).alias("n_removed"), F.coalesce("cuts", zero).alias("n_spans"), made).select("doc_id", "n_bytes", "n_removed", "n_spans", "made.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), outputs=lambda kept: [F.sha2(kept, 256).alias("kept_sha256")])
