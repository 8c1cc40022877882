"""Ascending whole numbers as differences of seven bits a byte, many lists at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack_lists(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """One binary value for each ascending list; list i begins at heads[i] of ``values``."""
    if not len(values):
        return pa.array([], pa.binary())
    steps = np.diff(values, prepend=0).astype(np.uint64)
    steps[heads] = values[heads]
    size = np.ones(len(steps), dtype=np.int64)
    for i in range(1, 9):
        size += steps >= np.uint64(1 << 7 * i)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], dtype=np.uint8)
    for i in range(int(size.max())):
        has = np.flatnonzero(size > i)
        more = np.where(size[has] > i + 1, 128, 0).astype(np.uint8)
        digit = (steps[has] >> np.uint64(7 * i)) & np.uint64(127)
        out[at[has] + i] = digit.astype(np.uint8) | more
    offsets = np.append(at[heads], at[-1]).astype(np.int64)
    packed = pa.Array.from_buffers(
        pa.large_binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(out)]
    )
    return packed.cast(pa.binary())


def unpack_lists(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, number of values of each list)."""
    if isinstance(packed, pa.ChunkedArray):
        packed = packed.combine_chunks()
    packed = packed.cast(pa.large_binary())
    if not len(packed):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, offset_buffer, data_buffer = packed.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[packed.offset :][: len(packed) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(len(packed), dtype=np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    digits = (data & 127).astype(np.int64) << (7 * place)
    steps = np.add.reduceat(digits, first)
    ends = np.searchsorted(last, offsets[1:])
    counts = np.diff(ends, prepend=0)
    sums = np.cumsum(steps)
    before = np.concatenate([[0], sums])[ends - counts]
    return sums - np.repeat(before, counts), counts
