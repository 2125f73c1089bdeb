"""A versioned key-value table in a folder: batches, snapshots, seal, flush and maintenance rounds.

A manifest version names the active generation, the sealed ones, the base table and
its frontier. Every change writes new files first and then the next manifest, which
must not exist yet: readers see one version or the next, and of two writers one
fails. Log rows lie in a folder a generation and lsn range; the base holds one
winner a key. Old files stay until ``vacuum``.

Defined results: an empty batch takes no lsn; a released batch fills its hole in the
lsn order but its rows stay invisible; reads of a snapshot see whole batches only; a
round without anything to do installs nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import fold, log, reads
from siltstone.sources.scratch import Files

OPS = "batch_id long, pos long, op string, key string, value string"
_LOG = "batch_id long, pos long, op string, key string, value string, lsn long, gen long, seq long, entry_count long, crc long"
_BASE = "key string, lsn long, op string, value string"


class Conflict(RuntimeError):
    """Another writer installed a version first."""


class BackPressure(RuntimeError):
    """More batches are unresolved than the window holds; no lsn was used."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_lsn: int = 1
    active: int = 0
    sealed: tuple[int, ...] = ()
    #: (folder, generation, first lsn, last lsn) of the log.
    pieces: tuple[tuple[str, int, int, int], ...] = ()
    #: Ranges of lsn taken by batches that are not yet published or released.
    pending: tuple[tuple[int, int], ...] = ()
    released: tuple[tuple[int, int], ...] = ()
    base: str | None = None
    frontier: int = 0
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def durable(self) -> int:
        """The last lsn before the first pending one."""
        return min((a for a, _ in self.pending), default=self.next_lsn) - 1


class Store:
    """One folder's table. ``window`` bounds lsn that are pending at once."""

    def __init__(self, spark: SparkSession, path: str, window: int = 1 << 20):
        self.spark, self.path, self.window = spark, path.rstrip("/"), window
        self.files = Files(spark, self.path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, force: bool = False, **more: int) -> Store:
        """A new table; one that is there is kept and refused, or removed with ``force``."""
        store = cls(spark, path, **more)
        if store.files.names("manifest"):
            if not force:
                raise FileExistsError(path)
            store.files.delete("")
        store.files.put_new(store._name(0), json.dumps(asdict(Manifest())))
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, **more: int) -> Store:
        """The table that is there; batches left pending by a writer that went away are released."""
        store = cls(spark, path, **more)
        now = store.manifest()
        if now.pending:
            store._install(now, released=now.released + now.pending, pending=())
        return store

    # --- versions ---

    @staticmethod
    def _name(version: int) -> str:
        return f"manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.files.names("manifest") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> Manifest:
        every = self.versions()
        if not every:
            raise FileNotFoundError(self.path)
        raw = json.loads(self.files.read(self._name(every[-1] if version is None else version)))
        pairs = lambda x: tuple(tuple(p) for p in x)
        return Manifest(**raw | {"sealed": tuple(raw["sealed"]), **{k: pairs(raw[k]) for k in ("pieces", "pending", "released")}})

    def _install(self, before: Manifest, **changes: object) -> Manifest:
        now = replace(before, version=before.version + 1, **changes)
        if not self.files.put_new(self._name(now.version), json.dumps(asdict(now))):
            raise Conflict(f"version {now.version} of {self.path} is there already")
        return now

    # --- batches ---

    def stage(self, ops: DataFrame) -> tuple[int, int] | None:
        """Append canonical batches (OPS) to the active generation as pending; their range of lsn, or None for no rows.

        Batches are numbered in the order of their ids, without gaps; a range is
        taken in the manifest before any row is written.
        """
        kept = log.canonicalize(ops.select(*[c.split()[0] for c in OPS.split(", ")]))
        batches = log.dense_numbers(kept.select("batch_id").distinct(), "batch_id", "n")
        n = batches.count()
        if not n:
            return None
        before = self.manifest()
        if sum(b - a + 1 for a, b in before.pending) + n > self.window:
            raise BackPressure(f"{n} batches do not fit into the window of {self.window}")
        first, last = before.next_lsn, before.next_lsn + n - 1
        piece = f"log/gen={before.active}/lsn={first}-{last}-{uuid.uuid4().hex}"
        self._install(before, next_lsn=last + 1, pending=(*before.pending, (first, last)), pieces=(*before.pieces, (piece, before.active, first, last)))
        sizes = kept.groupBy("batch_id").agg(F.count("*").alias("entry_count"))
        rows = kept.join(batches, "batch_id").join(sizes, "batch_id").withColumn("lsn", (F.col("n") + F.lit(first - 1)).cast("long"))
        crc = F.crc32(F.concat_ws("\0", "op", "key", F.coalesce("value", F.lit("")), F.col("lsn").cast("string")).cast("binary"))
        rows = rows.select("batch_id", "pos", "op", "key", "value", "lsn", F.lit(before.active).cast("long").alias("gen"), F.col("lsn").alias("seq"), "entry_count", crc.alias("crc"))
        rows.repartitionByRange("key").sortWithinPartitions("key", "lsn").write.mode("overwrite").parquet(f"{self.path}/{piece}")
        return first, last

    def resolve(self, taken: tuple[int, int], publish: bool = True) -> Manifest:
        """Publish a staged range, or release it: it then fills its hole, unseen."""
        now = self.manifest()
        if taken not in now.pending:
            raise ValueError(f"{taken} is not pending")
        left = tuple(p for p in now.pending if p != taken)
        key = "published" if publish else "released"
        counts = now.counts | {key: now.counts.get(key, 0) + taken[1] - taken[0] + 1}
        return self._install(now, pending=left, counts=counts, released=now.released if publish else (*now.released, taken))

    def apply(self, ops: DataFrame) -> tuple[int, int] | None:
        """Stage and publish; a failed write releases its range."""
        try:
            taken = self.stage(ops)
        except (BackPressure, Conflict):
            raise
        except Exception:
            now = self.manifest()
            if now.pending:
                self.resolve(now.pending[-1], publish=False)
            raise
        if taken:
            self.resolve(taken)
        return taken

    def put(self, rows: DataFrame) -> tuple[int, int] | None:
        """One batch of values from (key, value)."""
        return self.apply(rows.select(F.lit(0).cast("long").alias("batch_id"), F.monotonically_increasing_id().alias("pos"), F.lit("PUT").alias("op"), "key", "value"))

    def delete(self, keys: DataFrame) -> tuple[int, int] | None:
        """One batch of tombstones from (key)."""
        return self.apply(keys.select(F.lit(0).cast("long").alias("batch_id"), F.monotonically_increasing_id().alias("pos"), F.lit("DEL").alias("op"), "key", F.lit(None).cast("string").alias("value")))

    @contextmanager
    def batch(self) -> Iterator[Batch]:
        """A scope that reads one snapshot; what it puts is published as one batch at its end, or not at all on an error."""
        own = Batch(self, self.manifest())
        yield own
        own.finish()

    # --- reads ---

    def rows(self, at: Manifest) -> DataFrame:
        """Published log rows of a version above its frontier; folders wholly at or below it are not read."""
        holes = [p for p in at.released]
        paths = [f"{self.path}/{p}" for p, _, a, b in at.pieces if b > at.frontier and a <= at.durable and (a, b) not in holes]
        if not paths:
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(*paths).filter((F.col("lsn") <= at.durable) & (F.col("lsn") > at.frontier))

    def base(self, at: Manifest) -> DataFrame:
        return self.spark.read.schema(_BASE).parquet(f"{self.path}/{at.base}") if at.base else self.spark.createDataFrame([], _BASE)

    def snapshot(self, version: int | None = None, lsn: int | None = None) -> reads.Snapshot:
        """Reads of a version, at its durable lsn or an earlier one that is not below its frontier."""
        at = self.manifest(version)
        base = self.base(at).withColumn("seq", F.col("lsn"))  # a canonical batch has a key once, so its lsn orders rows
        return reads.Snapshot(self.rows(at), at.durable if lsn is None else lsn, base, at.frontier)

    # --- rounds ---

    def seal(self) -> Manifest:
        """Close the active generation and open the next; nothing without rows or while a batch is pending."""
        now = self.manifest()
        if now.pending or not any(g == now.active for _, g, _, _ in now.pieces):
            return now
        return self._install(now, sealed=(*now.sealed, now.active), active=now.active + 1)

    def flush(self) -> Manifest:
        """Fold sealed, durable generations, merge them into a new base and switch to it; nothing if there are none."""
        now = self.manifest()
        done = tuple(g for g in now.sealed if all(b <= now.durable for _, h, _, b in now.pieces if h == g))
        if not done:
            return now
        frontier = max(b for _, g, _, b in now.pieces if g in done)
        winners = reads.winners(self.rows(now).filter(F.col("lsn") <= frontier))
        path = f"base/{now.version + 1:012d}-{uuid.uuid4().hex}"
        merged = fold.leaf_merge(self.base(now), winners, frontier).select("key", "lsn", "op", "value")
        merged.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.path}/{path}")
        return self._install(now, base=path, frontier=frontier, sealed=tuple(g for g in now.sealed if g not in done), counts=now.counts | {"flushes": now.counts.get("flushes", 0) + 1})

    def reclaim(self) -> Manifest:
        """Forget log folders wholly at or below the frontier."""
        now = self.manifest()
        kept = tuple(p for p in now.pieces if p[3] > now.frontier)
        if kept == now.pieces:
            return now
        return self._install(now, pieces=kept, released=tuple(r for r in now.released if r[1] > now.frontier))

    def pressure(self) -> DataFrame:
        """(gen, n_rows, n_bytes, active) of the generations not yet flushed."""
        now = self.manifest()
        return fold.generations(self.rows(now)).select("gen", "n_rows", "n_bytes", (F.col("gen") == now.active).alias("active"))

    def maintain(self, seal_bytes: int, flush_gens: int) -> dict[str, bool]:
        """One round: seal if the active generation is large, flush if enough are sealed, then reclaim. What was done."""
        large = self.pressure().filter("active").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0] >= seal_bytes
        did, now = {}, self.manifest()
        did["sealed"] = large and self.seal() != now
        now = self.manifest()
        did["flushed"] = len(now.sealed) >= flush_gens and self.flush() != now
        now = self.manifest()
        did["reclaimed"] = self.reclaim() != now
        return did

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete versions but the newest ``keep``, and all files that none of those names; what was deleted."""
        gone = self.versions()[:-keep]
        live = [self.manifest(v) for v in self.versions()[-keep:]]
        used = {m.base for m in live} | {p[0] for m in live for p in m.pieces}
        out = [self._name(v) for v in gone]
        out += [f"base/{n}" for n in self.files.names("base") if f"base/{n}" not in used]
        out += [f"log/{g}/{n}" for g in self.files.names("log") for n in self.files.names(f"log/{g}") if f"log/{g}/{n}" not in used]
        for name in out:
            self.files.delete(name)
        return out

    # --- checkpoint ---

    def checkpoint(self, path: str) -> int:
        """Write the newest row of each key, tombstones left out, and return its lsn."""
        at = self.snapshot()
        reads.live(reads.winners(at.rows())).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/latest")
        Files(self.spark, path).put_new(f"at/{at.read_lsn:020d}", str(at.read_lsn))
        return at.read_lsn

    @classmethod
    def restore(cls, spark: SparkSession, source: str, path: str) -> Store:
        """A new table whose base is a checkpoint."""
        store, lsn = cls.create(spark, path), int(Files(spark, source).names("at")[-1])
        rows = spark.read.parquet(f"{source}/latest").withColumn("op", F.lit("PUT")).select("key", "lsn", "op", "value")
        rows.write.parquet(f"{store.path}/base/restored")
        store._install(store.manifest(), base="base/restored", frontier=lsn, next_lsn=lsn + 1)
        return store

    def stats(self) -> dict[str, int]:
        """Counters of the current version."""
        now = self.manifest()
        return {"version": now.version, "durable_lsn": now.durable, "next_lsn": now.next_lsn, "frontier": now.frontier, "generations": len({p[1] for p in now.pieces}), **now.counts}

    def verify(self) -> DataFrame:
        """(lsn, n_bad) of published rows whose checksum does not hold, and (lsn, missing) of batches that lost some."""
        crc = F.crc32(F.concat_ws("\0", "op", "key", F.coalesce("value", F.lit("")), F.col("lsn").cast("string")).cast("binary"))
        one = self.rows(self.manifest()).groupBy("lsn").agg(F.count_if(crc != F.col("crc")).alias("n_bad"), (F.max("entry_count") - F.count("*")).alias("missing"))
        return one.filter("n_bad > 0 OR missing <> 0")


class Batch:
    """Reads of one snapshot and writes that are published together."""

    def __init__(self, store: Store, at: Manifest):
        self.store, self.at, self.parts = store, at, []

    def get(self, keys: DataFrame) -> DataFrame:
        return self.store.snapshot(self.at.version).multi_get(keys)

    def scan(self, begin: str | None = None, end: str | None = None) -> DataFrame:
        return self.store.snapshot(self.at.version).scan(begin, end)

    def put(self, rows: DataFrame) -> None:
        self.parts.append(rows.select("key", "value", F.lit("PUT").alias("op")))

    def delete(self, keys: DataFrame) -> None:
        self.parts.append(keys.select("key", F.lit(None).cast("string").alias("value"), F.lit("DEL").alias("op")))

    def finish(self) -> tuple[int, int] | None:
        """Publish what was put; of several writes to a key the last counts. A scope that only read releases its snapshot."""
        ops = None
        for n, part in enumerate(self.parts):
            own = part.select(F.lit(0).cast("long").alias("batch_id"), F.lit(n).cast("long").alias("pos"), "op", "key", "value")
            ops = own if ops is None else ops.unionByName(own)
        return None if ops is None else self.store.apply(ops)
