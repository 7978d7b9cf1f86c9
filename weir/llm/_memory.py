"""Memory that is handed back: by Python workers, which Spark keeps idle beside the next stage's JVM, and by executors, whose heaps keep what an earlier stage took."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not every C library has it
        return lambda _: 0


_TABLES: list = []


def per_task(make):
    """``make`` cached for the length of a task: large tables that are quickly made again don't stay with an idle worker."""
    kept = cache(make)
    _TABLES.append(kept)
    return kept


def release() -> None:
    for kept in _TABLES:
        kept.cache_clear()
    trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(function):
    """``function`` over batches, whose freed memory goes back to the system at the end of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # others keep pages of their own
        try:
            yield from function(batches)
        finally:
            release()

    return run


def shrink(spark: SparkSession) -> None:
    """Ask executors to collect their garbage, upon which a JVM returns heap that it no longer fills. As many short tasks as take up all cores twice; an executor that gets none just stays as it is."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("x")).agg(F.count("x")).collect()
