"""Plumbing shared by the training-data operators: tables, shared work folder, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch to a Python worker. A text longer than that is a batch of its own.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20
#: Bytes of the six ASCII white-space characters, as the contracts list them.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Lower-cases A-Z and leaves every other byte, so UTF-8 sequences stay whole.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts by rows and bytes.

    Plans are lazy, so the bounds must still hold when a caller runs them: they stay on the session. They change no
    result, and a tighter bound of the caller's is left alone."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file:///tmp/checkpoints/{os.getpid()}-{uuid.uuid4().hex[:8]}"
    context.setCheckpointDir(base)
    atexit.register(_remove, spark, base)
    return base


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by then
        return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    _remove(spark, path)


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list, most: int = 1 << 19) -> Iterator[list]:
    """Runs of the texts of at most so many characters; a longer text is a run of its own."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def give_back() -> None:
    """Hand free memory back to the system: Python workers are used again, and so would their heaps be."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives its memory back when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that calls make() once a task and then its result on every batch with rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return released(run)


def free_names(keep: tuple[str, ...], own: list[str]) -> list[str]:
    """The kept columns' names; one that an operator's own column bears gets input_ in front until it is free."""
    taken, out = set(own), []
    for name in keep:
        while name in taken:
            name = f"input_{name}"
        taken.add(name)
        out.append(name)
    return out


class Carry:
    """Rows on their way through a Python worker: the kept columns by position, and what the operator reads.

    A string column that is kept and read travels once. Names cannot clash on the way; in the result a kept column that
    bears the name of one of the operator's own is called input_<name>."""

    def __init__(self, docs: DataFrame, keep: tuple[str, ...], **reads: str | Column):
        self.names = list(keep)
        columns = [docs[c].alias(f"__k{i}") for i, c in enumerate(keep)]
        self.at: dict[str, str] = {}
        for name, c in reads.items():
            if isinstance(c, str) and c in keep and docs.schema[c].dataType.simpleString() == "string":
                self.at[name] = f"__k{self.names.index(c)}"
            else:
                self.at[name] = f"__{name}"
                columns.append((docs[c] if isinstance(c, str) else c).cast("string").alias(f"__{name}"))
        self.rows = docs.select(*columns)
        self.fields = [f"__k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
        self.held = [f"__k{i}" for i in range(len(keep))]

    def run(self, task, own: str, rows: DataFrame | None = None) -> DataFrame:
        """task over the rows (or over rows made of them); own: the fields it adds behind the kept columns."""
        out = (self.rows if rows is None else rows).mapInArrow(task, ", ".join([*self.fields, own]))
        return self.named(out, [x.split()[0] for x in own.split(", ")])

    def named(self, out: DataFrame, own: list[str]) -> DataFrame:
        return out.select(*(F.col(h).alias(n) for h, n in zip(self.held, free_names(tuple(self.names), own))), *own)
