"""Arrow plumbing for operators that run numpy kernels over batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of one column's values that a kernel is given at once; a single longer value comes alone.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part's `column` holds about `most` bytes at most."""
    values = batch.column(batch.schema.get_field_index(column))
    start = held = 0
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def give_back() -> None:
    """Returns freed memory to the system. A worker is kept for later tasks and would else hold its largest task's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, sized_by: str, most: int = SLICE_BYTES) -> DataFrame:
    """kernel over slices of each Arrow batch, at most `most` bytes of column `sized_by` at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, sized_by, most):
                yield kernel(part)
        give_back()

    return df.mapInArrow(run, schema)
