"""What the training-data operators share: intermediate tables, words, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import drop_table, new_path, table  # noqa: F401: shared with the rest of the library

#: Rows in one Arrow batch handed to Python. Spark's own default of 10,000 rows
#: can be a gigabyte when texts are long.
BATCH_ROWS = 1000

#: White space that parts words in the contracts: space, and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def free_prefix(df: DataFrame, start: str) -> str:
    """A prefix for helper columns that no column of ``df`` begins with, in any case of letters."""
    while any(c.lower().startswith(start.lower()) for c in df.columns):
        start = "_" + start
    return start


def word_count(text: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """The words of a text in order; an empty array for null or white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % by


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.string()).cast(pa.binary()).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def one_blas_thread() -> None:
    """One matrix thread to a Python worker: Spark already runs one worker to a core."""
    import ctypes
    import glob
    import os

    import numpy as np

    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def keep_freed_memory() -> None:
    """Have the C library keep what numpy frees, 128 MB at most, where it can; else each large array is mapped and cleared anew."""
    import ctypes

    c = ctypes.CDLL(None)
    if hasattr(c, "mallopt"):
        c.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
        c.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD


def give_back_memory() -> None:
    """Have Arrow and the C library give what they hold unused back to the system; a worker that waits for its next task needs none of it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    c = ctypes.CDLL(None)
    if hasattr(c, "malloc_trim"):
        c.malloc_trim(0)
