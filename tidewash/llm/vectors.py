"""Columns of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, first places and values of a list column's vectors, all as doubles.

    The length is -1 where the vector is null, or has null or non-finite components.
    """
    values = column.flatten()  # without what null vectors may hide
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    firsts = np.cumsum(lengths) - lengths
    flat = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~np.isfinite(flat), out=bad[1:])
    wrong = bad[firsts + lengths] > bad[firsts]
    wrong |= np.asarray(column.is_null())
    return np.where(wrong, -1, lengths), firsts, flat


def matrix(rows: np.ndarray, firsts: np.ndarray, flat: np.ndarray, size: int) -> np.ndarray:
    """The vectors of the given rows, all of one size."""
    return flat[firsts[rows][:, None] + np.arange(size)]


def binary(matrix: np.ndarray) -> pa.Array:
    """Each row's bytes as one value."""
    plain = np.ascontiguousarray(matrix)
    size = plain.shape[1] * plain.itemsize
    offsets = np.arange(len(plain) + 1, dtype=np.int64) * size
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(plain), [None, pa.py_buffer(offsets), pa.py_buffer(plain)]
    )
    return found.cast(pa.binary())


def from_binary(column: pa.Array, kind: str, size: int) -> np.ndarray:
    """The matrix of a column that :func:`binary` made; all values have ``size`` components."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(len(column), size)
