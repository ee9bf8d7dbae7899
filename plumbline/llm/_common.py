"""What the operators share: word rules, shared scratch tables, checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.shared import ranked, ship, with_groups, written

__all__ = ["GAP", "SMALL_ROWS", "WORD", "byte_slices", "give_back", "ranked", "ship", "slices", "table", "with_groups", "word_array", "word_count", "written"]

#: A word, in Java's and Python's syntax; bytes.split() finds the same words in UTF-8.
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between words.
GAP = r"[\x20\x09-\x0D]+"
#: A table of at most so many rows may be broadcast, if its rows are of fixed width.
SMALL_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short slices, so that few texts are Python objects at a time; what a task used is given back."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of about `size` bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Returns what Arrow and the C library hold of freed memory, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """The words of a text that may be null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")
