"""Number arrays carried as binary cells, dealt to buckets: few wide rows in place of many narrow ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_HALF = np.uint64(32)


def bucket_of(code: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a 64-bit code by its upper half, so that sorted codes have sorted buckets."""
    return (((code >> _HALF) * np.uint64(buckets)) >> _HALF).astype(np.int64)


def cells(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """``values[cuts[i]:cuts[i + 1]]`` as one binary cell each."""
    offsets = (cuts * values.dtype.itemsize).astype(np.int32)
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def values_of(col: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All cells of a binary column in a row, and the n + 1 cuts between them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype), (offsets - offsets[0]) // np.dtype(dtype).itemsize


def dealt(bucket: np.ndarray, columns: Sequence[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """Cells for each bucket met; rows must already be in bucket order."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    cuts = np.concatenate([[0], cut, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    return bucket[cuts[:-1]] if len(bucket) else bucket, [cells(c, cuts) for c in columns]


def find(sorted_codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among ``sorted_codes``, and where."""
    if not len(sorted_codes):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(sorted_codes, wanted), len(sorted_codes) - 1)
    return sorted_codes[at] == wanted, at
