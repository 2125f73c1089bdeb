"""Stupid-backoff language-model scores against the rest of the corpus.

A document's n-grams are scored by their counts in all other documents: the
longest n-gram that occurs there gives count / count of its context, times
``BACKOFF`` for each step back; an unseen word counts as one of one more. Scores
are base-10 logarithms, summed over the document.

The relation is: n-grams exploded from documents, joined by hash to count tables
that are partitioned by hash, and summed by document. Its rows travel packed.
Documents are packed into chunks where they are read. A chunk sends each partition
of the count table the sorted hashes of its n-grams with its counts, the partition
sums them over all chunks and answers in the same order, and the chunk's documents
are scored where their chunk and its answers meet. A frequent n-gram brings one row
a chunk, and the packed tables hold 6 to 7 bytes an n-gram.

Words and pairs are counted in the first round. A longer n-gram can only be in
another document if both n-grams within it are, so each further round sends only
those whose parts the rounds before have found elsewhere. Hashes are of 64 bits;
n-grams that share one would add up.

Defined results: words are lower-cased (A-Z) runs without ASCII white space; a null
text counts as empty, and texts without words score 0; rows without an id and
repeated rows are documents of their own; a corpus of one document gives its words
1 of 1; an empty table gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import WordHash, bounded_batches, mix64, shuffle_parts, table, word_hashes, words_of
from siltstone.llm.runs import pack, part_of, unpack

BACKOFF = 0.4
#: Bytes of text in a chunk, and n-grams in a partition of the count table, about.
CHUNK, PARTITION = 6 << 20, 1_000_000
#: The key that counts all words.
ALL = np.uint64(0)


class Grams:
    """N-gram keys of a chunk's texts: ``keys[k]`` is the key of the (k+1)-gram that ends at each word (0 where none does).

    ``left[k]`` is how often that n-gram is in the other documents, once ``settle`` has been told.
    """

    def __init__(self, texts: list[str | None], order: int):
        seen = WordHash()
        words = [word_hashes(words_of(t), seen) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.text = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.keys, self.left, self.rest = [], [], None
        key = np.zeros(len(flat), np.uint64)
        for k in range(order):
            last = np.zeros(len(flat), np.uint64)
            last[k:] = flat[: len(flat) - k]
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + last + np.uint64(k + 1)) | np.uint64(1)
            self.keys.append(np.where(self.place >= k, key, ALL))

    def asked(self) -> list[tuple[int, np.ndarray]]:
        """The n-grams that the next round asks for: (order - 1, places)."""
        if not self.left:
            orders = range(min(2, len(self.keys)))
            return [(k, np.flatnonzero(self.place >= k)) for k in orders]
        k, below = len(self.left), self.left[-1] > 0
        return [(k, np.flatnonzero((self.place >= k) & below & np.roll(below, 1)))]

    def unique(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the next round, each asked place's index in them, and their counts; ALL counts the words."""
        keys, index, counts = np.unique(np.concatenate([[ALL], *(self.keys[k][at] for k, at in self.asked())]), return_inverse=True, return_counts=True)
        counts[0] = len(self.text)
        return keys, index[1:], counts

    def settle(self, counts: np.ndarray) -> None:
        """Counts of all documents for the keys of the next round, in their order."""
        keys, index, _ = self.unique()
        assert len(counts) == len(keys)
        if self.rest is None:
            self.rest = counts[0] - self.sizes  # words in the other documents
        for k, at in self.asked():
            own, index = index[: len(at)], index[len(at) :]
            # how often each place's n-gram is in its own document
            _, same, n = np.unique(self.text[at] * len(keys) + own, return_inverse=True, return_counts=True)
            self.left.append(np.zeros(len(self.text), np.int64))
            self.left[k][at] = counts[own] - n[same]

    def scores(self) -> np.ndarray:
        """The sum of each text's words."""
        n, order = len(self.text), len(self.keys)
        longest = np.minimum(order - 1, self.place)
        rest, done, out = self.rest[self.text], np.zeros(n, bool), np.zeros(n)
        for k in range(order - 1, -1, -1):
            context = np.roll(self.left[k - 1], 1) if k else rest
            # a context ends before the last word, so its last word may be missing from its own count
            use = ~done & (self.place >= k) & (self.left[k] > 0) & (context > 0)
            out[use] = np.log10(self.left[k][use] / context[use]) + (longest[use] - k) * math.log10(BACKOFF)
            done |= use
        out[~done] = -np.log10(rest[~done] + 1.0) + longest[~done] * math.log10(BACKOFF)
        return np.bincount(self.text, weights=out, minlength=len(self.sizes)) if n else np.zeros(len(self.sizes))


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(chunk: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(chunk.column("data")[0].as_py()).read_all()


def score(df: DataFrame, doc: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """(doc_id, n_words, log10_score): the sum of the words' scores, leaving the document itself out of the counts."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts, tasks = max(1, math.ceil(size / 4 / PARTITION)), shuffle_parts(df.sparkSession)
    rounds = max(1, order - 1)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text", CHUNK):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_packed(batch)], pa.binary())], names=["data"])

    docs = df.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(chunks, "data binary")
    docs = docs.withColumn("chunk", F.monotonically_increasing_id()).repartition(tasks, "chunk")

    def told(chunk: pa.Table, answers: pa.Table | None) -> tuple[pa.Table, Grams]:
        """A chunk's rows, and its n-grams with what the rounds so far have answered."""
        rows = _unpacked(chunk)
        g = Grams(rows.column("text").to_pylist(), order)
        if answers is not None and len(answers):
            answers = answers.sort_by([("round", "ascending"), ("part", "ascending")])
            number, data = answers.column("round").to_numpy(), answers.column("counts")
            for r in range(number.max() + 1):
                g.settle(np.concatenate([unpack(data[int(i)].as_py(), np.int64) for i in np.flatnonzero(number == r)]))
        return rows, g

    def ask(number: int, chunk: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        keys, _, counts = told(chunk, answers)[1].unique()
        part = part_of(keys, parts)
        cut = np.flatnonzero(np.diff(part)) + 1
        out = [(int(part[a]), pack(np.diff(keys[a:b], prepend=ALL)), pack(counts[a:b].astype(np.uint32))) for a, b in zip([0, *cut], [*cut, len(keys)], strict=True)]
        same = lambda x: pa.array([x] * len(out), pa.int64())
        columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
        return pa.table([same(number), columns[0], same(chunk.column("chunk")[0].as_py()), *columns[1:]], names=["round", "part", "chunk", "keys", "counts"])

    def total(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(k.as_py(), np.uint64), dtype=np.uint64) for k in t.column("keys")]
        counts = np.concatenate([unpack(c.as_py(), np.uint32) for c in t.column("counts")]).astype(np.int64)
        _, index = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(index, weights=counts).astype(np.int64)  # below 2^53
        own = np.split(sums[index], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table([t.column("chunk"), t.column("round"), t.column("part"), pa.array([pack(x) for x in own], pa.binary())], names=["chunk", "round", "part", "counts"])

    def rate(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows, g = told(chunk, answers)
        return pa.table({"doc_id": rows.column("id"), "n_words": pa.array(g.sizes), "log10_score": pa.array(g.scores())})

    def asker(number: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda chunk, answers: ask(number, chunk, answers)

    sent = "round long, part long, chunk long, keys binary, counts binary"
    answered = None
    for number in range(rounds):
        if answered is None:
            asked = docs.groupBy("chunk").applyInArrow(lambda chunk: ask(0, chunk), sent)
        else:
            asked = docs.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(asker(number), sent)
        fresh = asked.groupBy("part").applyInArrow(total, "chunk long, round long, part long, counts binary").repartition(tasks, "chunk")
        answered = fresh if answered is None else answered.unionByName(fresh)
    return docs.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(rate, "doc_id long, n_words long, log10_score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("log10_score", F.round("log10_score", 6))
