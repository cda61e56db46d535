"""Where operators keep written tables and files that every executor can read."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A writer holds a row group in memory; written tables are read whole, so small ones do.
ROW_GROUP_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a fresh local one serves a local session, whose
    executors are this machine; on a cluster that is an error, as nobody else could read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='verdigris-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            system, path = fs.FileSystem.from_uri(folder)
            system.delete_dir(path)


#: Rows in an Arrow batch between Spark and Python: a batch of texts is held whole on both sides.
BATCH_ROWS = 1024


def modest_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches have BATCH_ROWS rows at most, as long texts make large ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is run inside has Arrow batches of at most `rows` rows; the session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """What this process has freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """run, a generator over a task's or a group's batches, and give_back() after it: Spark keeps Python workers for later
    tasks, and what they have freed but not given back stands beside the heap of their executor.
    """

    @functools.wraps(run)
    def each(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return each


#: Keys that each hold more than this part of all rows are met by broadcast: fewer keys than this.
HOT_KEYS = 1024


def with_key_columns(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """rows with the columns of per_key, a row a key, whose column `count` says how many of the total rows have it.

    Rows of a hot key stay where they are, as hot keys are fewer than HOT_KEYS and broadcast; the others are
    shuffled, and no key of theirs is large. Both tables are read twice and should be written ones.
    """
    per_key = per_key.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    hot = per_key.where(F.col(count) * HOT_KEYS > F.lit(total))
    met = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return met.unionByName(others.join(per_key.where(F.col(count) * HOT_KEYS <= F.lit(total)), keys, how))
