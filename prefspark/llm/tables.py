"""Readers and small shared helpers of the llm operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.session import materialize

__all__ = ["read", "held_out", "text_buffers", "row_runs", "materialize", "partitions_for", "small_batches", "freed_shuffles", "discard", "release"]


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One input table by path, pruned to ``cols``."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text falls into ``fold``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Rows with large binary values go to Python in small batches while this lasts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """A written query's shuffle files go when it ends while this lasts, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def partitions_for(df: DataFrame) -> int:
    """The session's shuffle partition count (the cluster sizes it to its input)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def discard(table: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release() -> None:
    """Give freed memory back to the system: a Python worker is kept for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):                  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 row offsets into them.

    A null row is an empty one."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def row_runs(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes (one longer row stands alone)."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b
        a = b
