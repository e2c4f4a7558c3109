"""WARC records in seekable Zstandard bundles.

`bundle` packs pages into WARC/1.1 records, groups the records into independent Zstandard frames of about
`FRAME_BYTES`, and closes a bundle at `BUNDLE_BYTES` with a seek table in a skippable frame (the public seekable
format: compressed and decompressed size and checksum of each frame). A bundle row holds the archive and its index:
for each record its identifier, its frame, and offset and length within the decompressed frame. `fetch` reads single
records by decompressing only their frames; `read` reads whole archives.

A record whose payload (of at least `REVISIT_BYTES`) equals that of a record with a smaller page_id is written as a
revisit of the smallest. Only digests and page ids are grouped, with partial minima, and joined back, so a large group
of copies is never gathered in one task.

Bundles are rows of a Parquet table in the shared folder, so they go wherever Spark can write; `export` writes the
archives as .warc.zst files.

Defined results: a null html has an empty payload; a null url is left out of the record; rows without a page_id are
responses unless a row with one holds the same payload; rows that repeat the smallest page_id are all responses.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize

REVISIT_BYTES = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
LEVEL = 3
# Fixed values of the public seekable Zstandard format and of WARC/1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

BUNDLES = "bundle_id string, archive binary, records array<struct<record_id: string, page_id: bigint, frame: int, offset: bigint, length: bigint>>"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    value = rid[len("<urn:x-page:") : -1]
    return None if value == "none" else int(value)


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The fields of the record that begins at `at`, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, size = end + 4, int(head["Content-Length"])
    block = data[start : start + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    found = {
        "page_id": page_of(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": length, "payload_digest": digest,
        "refers_to": page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, "payload": payload if kind == "response" else None,
    }
    return found, start + size + 4


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.records: list[dict] = []
        self.open: list[bytes] = []
        self.size = self.written = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.records.append({"record_id": record_id(page_id), "page_id": page_id, "frame": len(self.frames), "offset": self.size, "length": len(record)})
        self.open.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.open:
            data = b"".join(self.open)
            frame = self.zstd.compress(data)
            self.frames.append(frame)
            self.entries.append((len(frame), len(data), xxh64_intdigest(data) & 0xFFFFFFFF))
            self.written += len(frame)
            self.open, self.size = [], 0

    def finish(self) -> tuple[bytes, list[dict]]:
        self.flush()
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table, self.records


class BundleReader:
    """Random access to the frames of an archive by the seek table at its end."""

    def __init__(self, archive: bytes):
        self.archive, self.zstd = archive, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", archive[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & CHECKSUM_FLAG else 8
        table = archive[len(archive) - 9 - n * width : -9]
        self.frames, at = [], 0
        for i in range(n):
            packed, size = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, size, struct.unpack_from("<I", table, i * width + 8)[0] if width == 12 else None))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, size, checksum = self.frames[i]
        data = self.zstd.decompress(self.archive[at : at + packed], max_output_size=size)
        if checksum is not None and xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return data

    def records(self) -> Iterator[dict]:
        for i in range(len(self.frames)):
            data, at = self.frame(i), 0
            while at < len(data):
                found, at = parse_record(data, at)
                yield found


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, revisit and refers_to of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n >= 2").select(F.col("digest").alias("same"), "first")
    joined = rows.join(firsts, (F.col("digest") == F.col("same")) & (F.octet_length("payload") >= REVISIT_BYTES), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def bundle(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The bundles of all pages, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        n, writer = 0, BundleWriter(frame_bytes)
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))

        def done() -> pa.RecordBatch:
            archive, records = writer.finish()
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([archive], pa.binary()), pa.array([records], kind)], ["bundle_id", "archive", "records"])

        for batch in batches:
            for page, url, payload, digest, revisit, refers in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(page, write_record(page, url, payload, digest, refers, revisit))
                if writer.written + writer.size >= bundle_bytes:
                    yield done()
                    n, writer = n + 1, BundleWriter(frame_bytes)
        if writer.records:
            yield done()

    return marked(pages).mapInArrow(run, BUNDLES)


def write(pages: DataFrame, path: str | None = None, **sizes: int) -> DataFrame:
    """Write the bundles of all pages to the shared folder (or path) and return them as read back."""
    return materialize(bundle(pages, **sizes), "warc", path)


READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def as_batch(rows: list[dict], payload: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payload else {})
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def read(bundles: DataFrame, payload: bool = False) -> DataFrame:
    """Every record of the archives, decoded frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for r in BundleReader(archive.as_py()).records():
                    rows.append(r)
                    size += r["payload_bytes"] if payload else 0
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield as_batch(rows, payload)
                        rows, size = [], 0
                yield as_batch(rows, payload)

    return bundles.select("archive").mapInArrow(run, READ + (", payload binary" if payload else ""))


def index(bundles: DataFrame) -> DataFrame:
    """record_id, page_id, bundle_id, frame, offset and length of every record."""
    return bundles.select("bundle_id", F.explode("records").alias("r")).select("r.record_id", "r.page_id", "bundle_id", "r.frame", "r.offset", "r.length")


def fetch(bundles: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records (with payloads) of some pages: only the frames that hold them are decompressed."""
    wanted = index(bundles).join(page_ids.select(F.col("page_id").cast("long").alias("page_id")).dropDuplicates(), "page_id", "left_semi")
    places = wanted.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, places in zip(batch.column(0), batch.column(1).to_pylist()):
                reader, at, data = BundleReader(archive.as_py()), -1, b""
                for p in places:
                    if p["frame"] != at:
                        at, data = p["frame"], reader.frame(p["frame"])
                    yield as_batch([parse_record(data[p["offset"] : p["offset"] + p["length"]])[0]], True)

    return bundles.select("bundle_id", "archive").join(places, "bundle_id").select("archive", "places").mapInArrow(run, READ + ", payload binary")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each archive as <bundle_id>.warc.zst to a folder that all executors mount; returns path and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for name, archive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                paths.append((path := f"{folder}/{name}.warc.zst", len(archive)))
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(archive)
                os.replace(f"{path}.{os.getpid()}", path)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in paths]), pa.array([n for _, n in paths], pa.int64())], ["path", "bytes"])

    return bundles.select("bundle_id", "archive").mapInArrow(run, "path string, bytes bigint")
