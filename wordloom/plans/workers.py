"""What Python workers do at the end of a task.

Spark reuses its workers, and freed memory stays with a worker's allocators, so a
worker would keep the peak of every stage that it has served.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a column that a function gets at once; a longer value comes alone.
SLICE = 1 << 20


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of ``mapInArrow`` that releases memory once its partition is done."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def slices(column: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """A column of strings or bytes in runs of bounded size."""
    lo, held = 0, 0
    for hi, size in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if hi > lo and held + size > most:
            yield column.slice(lo, hi - lo)
            lo, held = hi, 0
        held += size
    yield column.slice(lo)


def in_slices(run: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """A function of one column for an iterating ``arrow_udf``: it gets slices of bounded size, and memory is released once its partition is done."""

    def task(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                yield from map(run, slices(batch))
        finally:
            release()

    return task
