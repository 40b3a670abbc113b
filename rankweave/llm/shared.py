"""Helpers that several operators use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark) -> str:
    """The checkpoint folder that the session names; one in the temporary folder only where none is set and Spark runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and (master.startswith("local-cluster") or not master.startswith("local")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or f"{tempfile.gettempdir()}/checkpoints"


#: Whether Spark deletes a query's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder: later reads don't run the plan again, and lost executors lose nothing."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Bytes of rows that Spark gathers outside its heap before it hands them to a Python worker, which holds them as well.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark, size: int) -> Iterator[None]:
    """What runs inside gets its rows in batches of so many bytes at most, or of one row."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def give_back() -> None:
    """Gives memory that this process has freed back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow or mapInPandas that gives memory back at its end: a worker outlives its task, beside a JVM that sorts and joins next."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, after their last use: what is still lazy mustn't read them."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.written_to
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)


def ascii_lower(text):
    """Lower-cases A-Z only. Where a text is ASCII throughout, lower() does the same and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
