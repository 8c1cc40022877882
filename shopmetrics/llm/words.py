"""Words of Arrow text columns, split and hashed for whole batches at once.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. Hashes are 64-bit polynomial hashes taken from prefix
sums, so that a batch costs a fixed number of array operations, each finished
with a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Odd multipliers and their inverses modulo 2**64: one pair for bytes of a word,
# two for words of a run.
BYTE_BASE = 0x9E3779B97F4A7C15 | 3
RUN_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F | 3)
# Texts are hashed in slices of about this many bytes; a longer text is one slice.
SLICE_BYTES = 1 << 19

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def forget_powers() -> None:
    _POWERS.clear()


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Hashed words of consecutive texts: words of text i are first[i] to first[i + 1]."""

    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


class Runs:
    """Hashes of any run of words, from prefix sums over one slice."""

    def __init__(self, hashes: np.ndarray, base: int = RUN_BASES[0]):
        n = len(hashes)
        self.back = powers(inverse(base), n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of the words of texts data[offsets[i]:offsets[i + 1]]."""
    if len(data) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1] | edge[1:-1]
    ends[:-1] &= space[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Hashed words of the texts data[offsets[i]:offsets[i + 1]]."""
    n = len(data)
    start, stop = bounds(data, offsets)
    if n == 0:
        return Words(np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.uint64))
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(BYTE_BASE, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(terms, out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * powers(inverse(BYTE_BASE), n)[start])
    return Words(np.searchsorted(start, offsets).astype(np.int64), hashes)


def byte_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, bytes, offsets) of consecutive texts of an Arrow array.

    Null texts count as empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(texts)
    if rows == 0:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        part = offsets[row : stop + 1]
        yield row, data[part[0] : part[-1]], part - part[0]
        row = stop


def slices(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """(row of the first text, hashed words) of consecutive texts of an Arrow array."""
    for row, data, offsets in byte_slices(texts):
        yield row, split(data, offsets, lower)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs."""
    return x.view(np.int64)
