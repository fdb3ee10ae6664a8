"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of a batch that a Python worker holds, where the session names none: whole texts stay few at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Lets Python workers import this package where they share the driver's disk, and keeps their batches small.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    own = spark.sparkContext.getConf()
    for key, value in BATCH.items():
        if not own.contains(key):
            spark.conf.set(key, value)


_local: str | None = None


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    global _local
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _local = base = _local or tempfile.mkdtemp(prefix="piiprism-")  # one machine: tests and local runs
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.shared_table)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Tasks that the rows of one key are dealt to in a join.
SALTS = 16


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined by key with a table of small rows that has each key once. The table is repeated for each salt, so a
    key that a third of all rows share is no single task's work; by: what deals the rows of a key."""
    from pyspark.sql import functions as F

    each = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(each, [key, "_salt"], how).drop("_salt")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Remembered(dict):
    """What a function gives for a word, for the words of a task: two generations of at most `most` words each.

    It belongs to one task and goes with it. Long words are not remembered, so its bytes are bounded too.
    """

    def __init__(self, find: Callable, most: int = 40_000, longest: int = 64):
        self.find, self.most, self.longest, self.older = find, most, longest, {}

    def __missing__(self, word):
        found = self.older.get(word)
        if found is None:
            found = self.find(word)
            if len(word) > self.longest:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that gives the memory it took back to the system when it ends: Python workers outlive their tasks."""

    def task(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return task
