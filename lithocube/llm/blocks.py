"""Shuffling many small entries as few packed blocks: rows (bucket, payload columns of bytes)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


def bucket_count(spark: SparkSession, entries: int, each: int) -> int:
    """Buckets for so many entries, in proportion to them; at least one for each shuffle partition."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // each)))


def pack(values: np.ndarray, width: int) -> bytes:
    """Whole numbers as `width` low bytes each."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def cells(data: bytes | np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A column of binary values: data cut at bounds, len + 1 places in it."""
    buffer = pa.py_buffer(data if isinstance(data, bytes) else np.ascontiguousarray(data).data)
    if bounds[-1] > 2**31 - 1:
        raise ValueError("a block of more than 2 GB: ask for more buckets")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), buffer])


def packed_batch(bucket: np.ndarray, columns: dict[str, tuple[np.ndarray, int]], more: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    """Entries as one row for each bucket that has any, columns (values, bytes each) packed in the order they come. Values of
    16 bytes are rows of two numbers."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_bucket[1:] != sorted_bucket[:-1]])) if len(order) else np.zeros(0, np.int64)
    bounds = np.concatenate([first, [len(order)]])
    arrays = [pa.array(sorted_bucket[first].astype(np.int32))]
    for values, width in columns.values():
        data = np.ascontiguousarray(values[order]) if width == 16 else pack(values[order], width)
        arrays.append(cells(data if isinstance(data, bytes) else data.tobytes(), bounds * width))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def joined(column: pa.ChunkedArray | pa.Array) -> bytes:
    """The bytes of all values of a binary column."""
    return b"".join(column.to_pylist())
