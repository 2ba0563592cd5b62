"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom.plans.workspace import scratch_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and go on from the table, so that a lost executor repeats no work."""
    path = scratch_table(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_name(name: str, *taken: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has, in any case of letters."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, limit: int = 2_000_000) -> None:
    """Let the session hand Python batches of about ``limit`` bytes, where it sets no size itself.

    Spark's own limits are 10,000 rows and 64 MB; long texts fill these, once beside the heap of the executor and several
    times in each worker.
    """
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, str(limit))


def byte_column(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column of an Arrow batch as one array, and the offsets of its rows (nulls: empty)."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    elif not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string()).cast(pa.large_binary())
    col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def byte_batches(batches, name: str, limit: int = 8_000_000):
    """Arrow batches cut so that one slice holds about ``limit`` bytes of the named column, or a single row.

    After the last one, memory that is free goes back to the system, as a worker may wait long for its next task.
    """
    batch = at = None
    for batch in batches:
        _, at = byte_column(batch, name)
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end
    del batch, at
    give_back()


def give_back() -> None:
    """Return memory that is free but still held to the system, as a Python worker waits for its next task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
