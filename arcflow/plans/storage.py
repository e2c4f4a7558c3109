"""Where intermediate relations are kept: reliable files in a folder that all executors share."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder of our own where it is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base and context._jsc.sc().getCheckpointDir().isDefined():
        base = context._jsc.sc().getCheckpointDir().get()
    if base:
        return base
    if not context.master.startswith("local[") and context.master != "local":
        raise StorageError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file:///tmp/checkpoints/{os.getpid()}-{uuid.uuid4().hex[:8]}"
    context.setCheckpointDir(base)
    atexit.register(remove, spark, base)
    return base


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; the session may be gone by then."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001
        return


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/arcflow/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """Write df as Parquet and read it back: the lineage ends here and survives lost executors."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_counted(df: DataFrame, name: str = "step", path: str | None = None, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """store, and sums of rows (n: all of them) that the writing job itself observes, so loops need no job to count."""
    seen = Observation()
    held = df.observe(seen, F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()))
    out = store(held, name, path)
    return out, {k: v or 0 for k, v in seen.get.items()}


class Rounds:
    """The rows of a loop, one file set a round in one folder; `rows` reads them all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n, self.schema = spark, fresh_path(spark, name), 0, None
        #: Rows of the last round.
        self.last = 0
        self.found: dict[str, int] = {}

    def add(self, df: DataFrame, **counts: Column) -> DataFrame:
        self.schema = df.schema
        self.n += 1
        out, self.found = store_counted(df, path=f"{self.path}/round={self.n}", **counts)
        self.last = self.found["n"]
        return out

    def rows(self) -> DataFrame:
        paths = [f"{self.path}/round={i + 1}" for i in range(self.n)]
        return self.spark.read.schema(self.schema).parquet(*paths)
