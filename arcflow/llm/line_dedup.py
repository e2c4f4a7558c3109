"""Line dedup over sharded cuckoo filters backed by exact reference-count tables.

State (Parquet in a folder of the store):

* `refs`: the exact reference table, a row for each distinct (key, document), dealt to shards by the key;
* `filters`: a cuckoo filter for each shard that holds every key with two documents or more.

A line's key is the line stripped of the six ASCII white-space characters with A-Z lower-cased; keys of fewer than
`MIN_CHARS` code points are never counted. Keys are held as 128-bit BLAKE2b digests.

A filter past 85 % of its slots is built anew for twice its keys, out of the exact counts.

`build` counts a corpus, `insert` adds documents and `delete` takes documents out again: each brings the reference
counts and the filters up to date, so the decisions after a deletion are those that a corpus without these documents
would have given. An update writes what it changes and counts the keys it touches; the reference table is scanned, and
written anew only every `LAYERS` updates. `apply` drops lines: a probe of the shard's filter settles most lines (a cuckoo filter has no false
negatives), and the exact counts settle the rest. All lines of a shared key go except those of the document with the
smallest doc_id.

Hot keys: references are counted with partial sums before they move; the filter of a shard is dealt to `REPLICAS`
tasks, over which the shard's lines are salted by document; the exact join has no operator above it that needs a
key's rows together, so adaptive execution splits a hot key.

Defined results: a null or empty text is one empty line; documents with a null doc_id count for no key and keep all
their lines; rows that repeat a doc_id are one document in the counts, and each row loses its lines alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACES, Carry, byte_texts, delete_path, materialize, new_path, per_batch, released

MIN_CHARS = 10
REPLICAS = 16
SLOTS = 4
MAX_KICKS = 500
#: Updates that a store is read through before its tables are written anew.
LAYERS = 8


def line_key(line: bytes) -> bytes | None:
    """The digest of a line's key, or None for a line too short to count."""
    key = line.strip(SPACES)
    if len(key) < MIN_CHARS or (not key.isascii() and len(key.decode("utf-8", "replace")) < MIN_CHARS):
        return None
    return hashlib.blake2b(key.translate(LOWER), digest_size=16).digest()


class CuckooFilter:
    """Buckets of SLOTS 16-bit fingerprints in numpy; deletable, without false negatives."""

    def __init__(self, n_keys: int, table: np.ndarray | None = None, overflow: list[tuple[int, int]] | None = None):
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, n_keys) / SLOTS / 0.85))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1
        #: Fingerprints that found no slot, with their bucket: kept exactly, so that nothing is lost.
        self.overflow = overflow or []

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys (n x 2 uint64)."""
        tag = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
        tag[tag == 0] = 1
        first = (keys[:, 0] & np.uint64(self.mask)).astype(np.int64)
        return tag, first, self.other(first, tag)

    def other(self, bucket, tag):
        return (bucket ^ (np.asarray(tag).astype(np.int64) * 0x5BD1E995)) & self.mask

    def add(self, keys: np.ndarray) -> None:
        rng = np.random.default_rng(1)
        for tag, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = tag
                    break
            else:
                at = a
                for _ in range(MAX_KICKS):
                    slot = int(rng.integers(SLOTS))
                    tag, self.table[at, slot] = int(self.table[at, slot]), tag
                    at = int(self.other(at, tag))
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = tag
                        break
                else:
                    self.overflow.append((at, tag))

    def remove(self, keys: np.ndarray) -> None:
        for tag, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for bucket in (a, b):
                if (bucket, tag) in self.overflow:
                    self.overflow.remove((bucket, tag))
                    break
                found = np.flatnonzero(self.table[bucket] == tag)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break

    def has(self, keys: np.ndarray) -> np.ndarray:
        tag, a, b = self.places(keys)
        found = (self.table[a] == tag[:, None]).any(1) | (self.table[b] == tag[:, None]).any(1)
        for bucket, t in self.overflow:
            found |= (tag == t) & ((a == bucket) | (b == bucket))
        return found

    def is_full(self) -> bool:
        """Whether the filter should be built anew for more keys: past 85 % of its slots, or with keys that found none."""
        return bool(self.overflow) or int((self.table != 0).sum()) > 0.85 * self.table.size

    def dump(self) -> bytes:
        return b"%d %d\n" % (len(self.table), len(self.overflow)) + self.table.tobytes() + np.array(self.overflow, np.int64).tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        head, _, body = data.partition(b"\n")
        n, extra = map(int, head.split())
        table = np.frombuffer(body[: n * SLOTS * 2], np.uint16).reshape(n, SLOTS).copy()
        return cls(0, table, [tuple(x) for x in np.frombuffer(body[n * SLOTS * 2 :], np.int64).reshape(extra, 2).tolist()])


def pair(keys: pa.Array | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist() if isinstance(keys, pa.Array) else keys), "<u8").reshape(-1, 2)


# -- references ----------------------------------------------------------------------------------
def line_refs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each distinct (key, document)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ids = [], []
        for doc, t in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
            if doc is not None:
                own = {k for line in t.split(b"\n") if (k := line_key(line))}
                keys += own
                ids += [doc] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(per_batch(lambda: work), "key binary, doc_id bigint")


def counts(refs: DataFrame) -> DataFrame:
    """Reference counts: by key the number of documents and the first of them. Partial sums before the shuffle."""
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def shared_keys(refs: DataFrame) -> DataFrame:
    """The counts of the keys of two documents or more."""
    return counts(refs).where("n_docs >= 2")


def shard_of(key: str, shards: int):
    return F.pmod(F.crc32(key), F.lit(shards)).cast("int").alias("shard")


def build_filters(shared: DataFrame, shards: int, room: int = 1) -> DataFrame:
    """The cuckoo filter of each shard. A shard's keys come in one run, sorted, and are held packed, 16 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, bytearray()

        def done() -> pa.RecordBatch:
            keys = np.frombuffer(bytes(held), "<u8").reshape(-1, 2)
            f = CuckooFilter(room * len(keys))
            f.add(keys)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([f.dump()], pa.binary())], ["shard", "filter"])

        for batch in batches:
            for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, held = shard, bytearray()
                held += key
        if now is not None:
            yield done()

    return shared.select(shard_of("key", shards), "key").repartition("shard").sortWithinPartitions("shard").mapInArrow(released(run), "shard int, filter binary")


def probe(refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The references whose key may be shared. Each task meets a shard's filter first and then its keys."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(REPLICAS - 1))).alias("salt")
    tables = filters.select("shard", salt, "filter", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
    lines = refs.select(shard_of("key", shards), F.pmod("doc_id", F.lit(REPLICAS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("filter"), "key", "doc_id")
    both = tables.unionByName(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("key").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for batch in batches:
            shard, blobs = batch.column("shard").to_pylist(), batch.column("filter")
            keys, docs = batch.column("key"), batch.column("doc_id")
            starts = sorted({0, *np.flatnonzero(np.asarray(blobs.is_valid())).tolist(), *(np.flatnonzero(np.diff(shard)) + 1).tolist()})
            for a, b in zip(starts, [*starts[1:], len(shard)]):
                if shard[a] != now:
                    now, known = shard[a], None
                if blobs[a].is_valid:
                    known = CuckooFilter.load(blobs[a].as_py())
                    a += 1
                if known is not None and b > a:
                    hit = pa.array(known.has(pair(keys[a:b])))
                    yield pa.RecordBatch.from_arrays([keys[a:b].filter(hit), docs[a:b].filter(hit)], ["key", "doc_id"])

    return both.mapInArrow(released(run), "key binary, doc_id bigint")


# -- the store -----------------------------------------------------------------------------------
class LineStore:
    """Reference table and filters of a corpus. Folders are written once and never changed; a store reads those of the
    stores it came from too, so discard these only after it."""

    def __init__(self, spark: SparkSession, path: str, refs: DataFrame, shards: int, filters: DataFrame | None = None, shared: DataFrame | None = None, layers: int = 0):
        self.spark, self.path, self.refs, self.shards, self.layers = spark, path, refs, shards, layers
        # A table of its own: a join on it can split a hot key, which it cannot above the aggregation.
        self.shared = shared if shared is not None else materialize(shared_keys(refs), "shared", f"{path}/shared")
        self.filters = filters if filters is not None else materialize(build_filters(self.shared, shards), "filters", f"{path}/filters")

    @classmethod
    def build(cls, docs: DataFrame, shards: int | None = None, text: str = "text") -> LineStore:
        spark = docs.sparkSession
        path = new_path(spark, "lines")
        shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        refs = line_refs(docs, text)
        return cls(spark, path, materialize(refs, "refs", f"{path}/refs"), shards)

    def insert(self, docs: DataFrame, text: str = "text") -> LineStore:
        """The store with these documents too: a document that is there already gains the lines it lacks."""
        path, ref = new_path(self.spark, "lines"), ["key", "doc_id"]
        new = materialize(line_refs(docs, text).dropDuplicates(ref), "new", f"{path}/new")
        there = self.refs.join(new, ref, "left_semi")
        added = materialize(new.join(there, ref, "left_anti"), "added", f"{path}/added")
        return self._next(path, self.refs.unionByName(added), added)

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """The store without the documents whose doc_id is listed."""
        path = new_path(self.spark, "lines")
        ids = materialize(doc_ids.select(F.col("doc_id").cast("long")).dropDuplicates(), "ids", f"{path}/ids")
        return self._next(path, self.refs.join(ids, "doc_id", "left_anti"), self.refs.join(ids, "doc_id", "left_semi"))

    def _next(self, path: str, refs: DataFrame, touched: DataFrame) -> LineStore:
        """Only keys that the update touches are counted again, and only those that became shared, or stopped being so,
        are added to or removed from the filters. Tables are read through the updates; after LAYERS of them they are
        written anew."""
        keys = materialize(touched.select("key").dropDuplicates(), "keys", f"{path}/keys")
        now = materialize(shared_keys(refs.join(keys, "key", "left_semi")), "now", f"{path}/now")
        shared = self.shared.join(keys, "key", "left_anti").unionByName(now)
        was = self.shared.select("key").join(keys, "key", "left_semi").withColumn("was", F.lit(True))
        change = was.join(now.select("key", F.lit(True).alias("now")), "key", "full")
        change = change.select("key", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now")).where("was <> now")
        layers = self.layers + 1
        if layers > LAYERS:
            refs, shared, layers = materialize(refs, "refs", f"{path}/refs"), materialize(shared, "shared", f"{path}/shared"), 0
        rows = change.select(shard_of("key", self.shards), F.lit(None).cast("binary").alias("filter"), "key", F.col("now").alias("add"))
        old = self.filters.select("shard", "filter", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("boolean").alias("add"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, known, grow = None, None, []

            def done() -> pa.RecordBatch:
                final = known or CuckooFilter(max(len(grow), 64))
                # More new keys than a filter has free slots would only be pushed around: it is built anew instead.
                if len(grow) <= 0.85 * final.table.size - int((final.table != 0).sum()):
                    final.add(pair(grow)) if grow else None
                else:
                    final.overflow.append((0, 0))
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([final.dump()], pa.binary()), pa.array([final.is_full()])], ["shard", "filter", "full"])

            for batch in batches:
                for shard, blob, key, add in zip(*(batch.column(c).to_pylist() for c in ("shard", "filter", "key", "add"))):
                    if shard != now:
                        if now is not None:
                            yield done()
                        now, known, grow = shard, None, []
                    if blob is not None:
                        known = CuckooFilter.load(blob)
                    elif add:
                        grow.append(key)
                    elif known is not None:
                        known.remove(pair([key]))
            if now is not None:
                yield done()

        both = old.unionByName(rows).repartition("shard").sortWithinPartitions("shard", F.col("key").isNotNull())
        filters = materialize(both.mapInArrow(released(run), "shard int, filter binary, full boolean"), "filters", f"{path}/changed")
        full = filters.where("full").select("shard")
        if full.isEmpty():
            return LineStore(self.spark, path, refs, self.shards, filters.drop("full"), shared, layers)
        # Full filters grow: they are built anew out of the exact counts, for twice the keys they hold.
        crowded = shared.select(shard_of("key", self.shards), "key").join(full, "shard", "left_semi").select("key")
        grown = materialize(build_filters(crowded, self.shards, 2), "filters", f"{path}/grown")
        return LineStore(self.spark, path, refs, self.shards, filters.where("not full").drop("full").unionByName(grown), shared, layers)

    def drops(self, refs: DataFrame | None = None) -> DataFrame:
        """(doc_id, keys): by document the digests of the lines it loses."""
        may = probe(self.refs if refs is None else refs, self.filters, self.shards)
        lost = may.join(self.shared, "key").where("doc_id <> first_doc")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", known: bool = True, doc_id: str = "doc_id") -> DataFrame:
        """`keep`, n_lines, n_dropped and kept_text. known: the documents are those of the store."""
        drops = self.drops(None if known else line_refs(docs, text, doc_id))
        carry = Carry(docs, keep, text=text, id=docs[doc_id].cast("string"))
        held, at = carry.held, carry.at["text"]
        joined = carry.rows.join(drops.withColumnsRenamed({"doc_id": "__doc", "keys": "__keys"}), F.col("__id").cast("long") == F.col("__doc"), "left")

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_lines, n_dropped, kept = [], [], []
            for t, keys in zip(byte_texts(batch.column(at)), batch.column("__keys").to_pylist()):
                lines = t.split(b"\n")
                stay = lines
                if keys:
                    gone = set(keys)
                    stay = [x for x in lines if line_key(x) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            text_out = pa.array(kept, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([batch.column(c) for c in held] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), text_out], [*held, "n_lines", "n_dropped", "kept_text"])

        return carry.run(per_batch(lambda: work), "n_lines bigint, n_dropped bigint, kept_text string", joined.drop("__id", "__doc"))

    def discard(self) -> None:
        delete_path(self.spark, self.path)
