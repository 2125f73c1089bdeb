"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash answers whole pre-tokens that are in the
vocabulary; the rest are merged by a heap of pairs over linked bytes. Ids are
those of a rank file (base64 token, space, rank, one a line), and equal what the
tiktoken library gives without special tokens.

Defined results: a null or empty text has no ids and decodes to no bytes; a text
is encoded whole, however long (a pre-token of n bytes costs n log n); repeated
rows are encoded each; other columns are untouched.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.llm.common import bounded_batches, fresh, table, trimmed

#: Pre-tokens whose ids a worker remembers, in two generations of this many (some 60 MB both); bytes of text that are encoded at once.
REMEMBERED, SLICE = 200_000, 2 << 20


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, displace, compare.

    n keys take n slots. A bucket of about four keys stores one displacement
    that sends its keys to free slots; a bucket of one stores its slot.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = max(1, len(keys))
        m = self.m = max(1, n // 4)
        buckets: list[list[int]] = [[] for _ in range(m)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % m].append(i)
        self.shift, self.keys, self.values = [0] * m, [b""] * n, [-1] * n
        free, slot_of = [True] * n, self._slot
        spare = (s for s in range(n) if free[s])  # read only once the larger buckets have their slots
        for b in sorted(range(m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) == 1:
                slot = next(spare)
                self.shift[b], slots = -slot - 1, [slot]
            elif own:
                d = 0
                while True:
                    slots = [slot_of(hashes[i], d) for i in own]
                    if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            else:
                continue
            for i, s in zip(own, slots, strict=True):
                free[s], self.keys[s], self.values[s] = False, keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        return (((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


class Vocabulary:
    """Tokens by rank, the perfect hash of whole tokens, and the pairs that merge."""

    def __init__(self, lines: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.tokens = {r: t for t, r in ranks.items()}
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}  # by first << 32 | second: numbers are half as large as tuples of them
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.whole.get(piece)
        return [rank] if rank >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Join the pair of lowest rank, leftmost first, until none is left."""
        ids, pairs = [self.byte[x] for x in piece], self.pairs
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := pairs.get(ids[p] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, p))
        return [x for x in ids if x >= 0]


class Packed(dict):
    """Pre-token -> its ids as little-endian bytes; forgets the older half when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: list[str] | None = None, decoded: bool = True) -> DataFrame:
    """Adds ``n_tokens`` long, ``ids`` (little-endian uint32, packed) and, if wanted, ``decoded`` (their bytes).

    ``keep`` are the columns that go on, all of them if it is None. The driver reads
    the rank file and broadcasts the vocabulary, whose size does not depend on the
    data. One pass over the rows, without a shuffle.
    """
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(rank_file))
    names = [c for c in (df.columns if keep is None else keep) if c not in ("n_tokens", "ids", "decoded")]
    schema = StructType([*df.select(*names).schema.fields]).add("n_tokens", "long").add("ids", "binary")
    schema = schema.add("decoded", "binary") if decoded else schema
    (sent,) = [text] if text in names else fresh(df, "_text")
    df = df.select(*names, *([] if text in names else [F.col(text).alias(sent)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        known = vocabulary.value
        find, packed, token = regex.compile(pattern).findall, Packed(known), known.tokens.__getitem__
        for batch in bounded_batches(batches, sent, SLICE):
            counts, ids, back = [], [], []
            for x in batch.column(batch.schema.get_field_index(sent)):
                got = b"".join(map(packed.__getitem__, find(x.as_py() or "")))
                ids.append(got)
                counts.append(len(got) // 4)
                if decoded:
                    back.append(b"".join(map(token, np.frombuffer(got, "<u4").tolist())))
            own = [*batch.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, pa.array(back, pa.binary())] if decoded else own, names=schema.names)

    return df.mapInArrow(trimmed(run), schema)


def decode(df: DataFrame, rank_file: str, ids: str = "ids", out: str = "text_bytes") -> DataFrame:
    """Adds ``out``: the bytes of packed ids. Null ids give no bytes; an unknown id is an error."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(rank_file))
    schema = StructType([*df.schema.fields]).add(out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary.value.tokens.__getitem__
        for batch in batches:
            got = [b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def tokenizer_files() -> tuple[str, str]:
    """Rank file and split pattern of the default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank_file, pattern = tokenizer_files()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, rank_file, pattern, keep=["doc_id"]).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
