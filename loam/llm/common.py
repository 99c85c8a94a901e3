"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.shared import cleanup, forget, release_shuffles, shared_dir, written  # noqa: F401  the operators take them from here

#: White space of the word, line and size contracts: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
#: Rows of an Arrow batch that a Python operator turns into objects at a time; Spark's own batches are larger.
SLICE = 1024
#: Bytes of text that one step of a Python operator holds at a time (a longer text is a step of its own).
STEP_BYTES = 2_000_000
HOT_ROWS = 100  #: rows up to which no key is hot


def hot_join(left: DataFrame, right: DataFrame, on: str, hot: list, how: str = "inner") -> DataFrame:
    """left.join(right, on), where each key of `hot` (a list of bounded length) has few rows on the right and any number on
    the left: those rows of the right are broadcast, so that no task gets all of a hot key's rows of the left."""
    if not hot:
        return left.join(right, on, how)
    keys = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], f"{on} {left.schema[on].dataType.simpleString()}").coalesce(1))
    rest = left.join(keys, on, "left_anti").join(right, on, how)
    return rest.unionByName(left.join(keys, on, "left_semi").join(F.broadcast(right.join(keys, on, "left_semi")), on, how))


HOT_KEYS = 1000  #: a key with more than one row in HOT_KEYS, or in two a shuffle partition, is hot; so there are no more hot keys than that


def hot_keys(counts: DataFrame, on: str, n: str = "n") -> list:
    """The keys of (on, n) that hold more than a HOT_KEYS-th of the sum of n (of more partitions, half of a partition's even share), and over HOT_ROWS rows."""
    share = max(HOT_KEYS, 2 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    least = max(HOT_ROWS, (total or 0) / share)
    return [r[0] for r in counts.filter(F.col(n) > least).select(on).collect()] if (most or 0) > least else []  # `share` keys at most


def held_out(doc_id: Column) -> Column:
    """The rows that no model may learn from: crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later stages, which have their own needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    release()


def steps(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of SLICE rows at most, whose texts (column number `text`) hold STEP_BYTES together, or one row."""
    for batch in slices(batches):
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP_BYTES, "right")))
            yield batch.slice(a, b - a)
            a = b


def rows_of(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[list[tuple]]:
    """The rows of Arrow batches as lists of tuples, a step at a time, so that no more than a step's texts are objects."""
    for step in steps(batches, text):
        yield list(zip(*(c.to_pylist() for c in step.columns), strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
