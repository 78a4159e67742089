"""What several corpus operators share: input tables, worker-wide caches, array helpers."""
from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z only: Unicode rules would turn other letters (the Kelvin sign) into ASCII."""
    return F.translate(text, UPPER, LOWER)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that later tasks of it find what earlier ones built."""
    holder = sys.modules.setdefault("_tidemark_llm_worker", types.ModuleType("_tidemark_llm_worker"))
    return holder.__dict__.setdefault(name, {})


#: rows of one Arrow batch where whole texts go to Python: a batch is held by the JVM, by its worker, and there once more
#: as Python strings
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` over Arrow batches, giving freed memory back to the machine when a task ends: a worker waits idle for the
    next task, and what the allocators keep would count against its executor until then."""
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside glibc
        if trim:
            trim(0)

    return run


def ramp(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every (start, length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
