"""Arrow batches of a column's values in pieces of bounded bytes, for functions that make Python objects of them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes that one Arrow batch of whole texts takes at most between JVM and Python (a longer row comes alone).
BATCH_BYTES = 16 << 20
#: Bytes of the first column that one step takes; a longer value comes alone.
PIECE_BYTES = 1 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None


def bounded(df: DataFrame) -> DataFrame:
    """``df``, about to go to Python: where the session says nothing of the bytes of Arrow batches, they are bounded by ``BATCH_BYTES``."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return a Python worker's freed memory to the machine: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batches: Iterator[pa.Array | tuple[pa.Array, ...]], limit: int = PIECE_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of ``batches`` in slices whose first column holds about ``limit`` bytes, in order; a batch without rows is one slice."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(columns[0]), 0), pa.int64())).to_pylist()
        start = 0
        while start < len(ends):
            stop, before = start + 1, ends[start - 1] if start else 0
            while stop < len(ends) and ends[stop] - before <= limit:
                stop += 1
            yield tuple(c.slice(start, stop - start) for c in columns)
            start = stop
        if not ends:
            yield columns
        give_back()


def mapped(change: Callable, batches: Iterator[pa.Array], kind: pa.DataType, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """``change`` of each value of strings or bytes, nulls left alone: what goes in and what comes out is held in pieces of about ``limit`` bytes."""
    for (piece,) in pieces(batches, limit):
        out, held = [], 0
        for value in piece:
            made = None if value.as_py() is None else change(value.as_py())
            out.append(made)
            held += len(made or b"")
            if held > limit:
                yield pa.array(out, kind)
                out, held = [], 0
        if out or not len(piece):
            yield pa.array(out, kind)
