"""Words of UTF-8 texts found by whole-array operations on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from churnwise.llm.common import release_memory


def blocks(batch: pa.RecordBatch, text: int, block_bytes: int) -> Iterator[tuple[int, int]]:
    """(first row, one past the last) of slices whose texts hold about ``block_bytes`` bytes."""
    at, held = 0, 0
    column = batch.column(text)
    for i in range(batch.num_rows):
        value = column[i]
        held += len(value.as_buffer()) if value.is_valid else 0
        if held >= block_bytes:
            yield at, i + 1
            release_memory()
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield at, batch.num_rows
    release_memory()


def joined(column: pa.Array, first: int, last: int, separator: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts of some rows, A-Z in lower case and each followed by ``separator``, and where
    each text begins; null counts as empty."""
    texts = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in column[first:last]]
    start = np.cumsum([0, *(len(t) + len(separator) for t in texts)])[:-1]
    return np.frombuffer(separator.join([*texts, b""]).lower(), np.uint8), start


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of True."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def as_array(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """The binary array of consecutive values of ``size`` bytes each."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
