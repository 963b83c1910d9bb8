"""Helpers the operators of this subpackage share: table reading, shared storage and Arrow batches."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_folder, stored  # noqa: F401  (part of what this module offers)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(batches, max_bytes: int = 2 << 20):
    """Cut Arrow batches into slices of about ``max_bytes``, so that long texts do not add up in memory.

    One row is never cut, so a slice holds at least one row. Workers are reused for other operators, so
    memory that Arrow frees goes back to the system.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, min(batch.num_rows, int(batch.num_rows * max_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system, where its C library can: a worker goes on to other operators."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's bounds in them; null counts as empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def squeeze(raw: bytes) -> bytes:
    """Compressed bytes behind their length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueeze(value: bytes) -> bytes:
    return pa.decompress(memoryview(value)[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Keep Arrow batches of whole texts small: at most ``rows`` rows each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
