"""Arrow text columns as numpy arrays of bytes or code points, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its offsets (one more than rows); nulls have no bytes."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, at - at[0] if len(at) else np.zeros(1, np.int64)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most `most` bytes; a longer row is a block of its own."""
    body, at = raw(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] of each segment, by one running sum."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64 if values.dtype.kind in "bui" else np.float64), np.cumsum(values, axis=0, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)])
    return total[ends] - total[starts]
