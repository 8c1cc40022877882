"""Lower-cased terms of Arrow text columns: runs of ASCII letters and digits and other characters.

A term is a run of bytes 0-9, a-z and 128 to 255 after A-Z became a-z; all other
characters separate. Texts are scanned in parts of bounded size, so that a very
long text costs memory in proportion to its terms only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from shopmetrics.llm.words import BYTE_BASE, byte_slices, inverse, mix, powers

# Bytes of a text that are scanned at once.
PART_BYTES = 1 << 20

_CODES = np.arange(256)
IN_TERM = (
    ((_CODES >= 48) & (_CODES <= 57))
    | ((_CODES >= 65) & (_CODES <= 90))
    | ((_CODES >= 97) & (_CODES <= 122))
    | (_CODES >= 128)
)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)


def separated_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, bytes with a line feed after each text, text starts).

    Null texts count as empty. There is one start more than texts.
    """
    for row, data, offsets in byte_slices(texts):
        joined = np.insert(data, offsets[1:], 10)
        yield row, joined, offsets + np.arange(len(offsets))


def parts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of bytes that end with a separator; each part has whole terms."""
    low, n = 0, len(data)
    while low < n:
        high = min(low + PART_BYTES, n)
        while high < n:
            apart = np.flatnonzero(~IN_TERM[data[low:high]])
            if len(apart):
                high = low + int(apart[-1]) + 1
                break
            high = min(high + PART_BYTES, n)
        yield low, high
        low = high


def term_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each term of a part."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = IN_TERM[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of each term of separated bytes."""
    starts, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for low, high in parts(data):
        part = data[low:high]
        begin, end = term_bounds(part)
        letters = LOWER[part].astype(np.uint64)
        letters += np.uint64(1)
        letters *= powers(BYTE_BASE, len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(letters, out=sums[1:])
        back = powers(inverse(BYTE_BASE), len(part) + 1)
        hashes.append(mix((sums[end] - sums[begin]) * back[begin]))
        starts.append(begin + low)
    return np.concatenate(starts), np.concatenate(hashes)


def hashed_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, first term of each text, term hashes)."""
    for row, data, starts in separated_slices(texts):
        begin, hashes = hashed(data)
        yield row, np.searchsorted(begin, starts), hashes
