"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..staging import materialize, shared_dir
from . import word_ids

__all__ = ["ascii_words", "documents", "map_arrow", "materialize", "shared_dir", "small_batches"]

#: Bytes of an Arrow batch between the JVM and Python; Spark's own limit is 64 MB.
BATCH = 4 << 20


def map_arrow(df: DataFrame, function, schema: str, lean: bool = False) -> DataFrame:
    """``mapInArrow`` with this package on the executors.

    A worker serves many tasks. With ``lean`` one drops what operators keep in it
    from task to task, and returns what it no longer needs to the system.
    """
    ship(df.sparkSession)
    return df.mapInArrow(_lean(function) if lean else function, schema)


def _lean(function):
    def run(batches):
        word_ids.forget()
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return this process's free memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH`` bytes from now on, unless the session bounds them itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_words(column: str = "text"):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
