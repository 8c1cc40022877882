"""CRC-32 of any stretch of a scanned byte string, from two stored prefixes.

CRC-32 is linear over GF(2): crc(AB) = shift(crc(A), |B|) ^ crc(B), where shift
feeds zero bytes. So the CRC of a stretch is the CRC of the prefix up to its end
with the shifted CRC of the prefix before it cancelled out, whatever its length.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320
# Bytes that a lane scans by itself; lanes of a part advance together.
LANE = 256


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


BYTE_TABLE = _byte_table()


def _feed_zero(state: np.ndarray) -> np.ndarray:
    return BYTE_TABLE[state & 255] ^ (state >> np.uint32(8))


def _by_table(table: np.ndarray, first: np.ndarray | int, crcs: np.ndarray) -> np.ndarray:
    """Linear map of CRCs by four tables of 256 entries that begin at ``first``."""
    out = table[first + (crcs & np.uint32(255)).astype(np.int64)]
    for j in (1, 2, 3):
        out ^= table[first + 256 * j + ((crcs >> np.uint32(8 * j)) & np.uint32(255)).astype(np.int64)]
    return out


def _short_tables() -> np.ndarray:
    """Shifts by 0 to LANE bytes, one after the other."""
    unit = np.arange(256, dtype=np.uint32)
    tables = [np.concatenate([unit << np.uint32(8 * j) for j in range(4)])]
    for _ in range(LANE):
        tables.append(_feed_zero(tables[-1]))
    return np.concatenate(tables)


SHORT = _short_tables()


def _long_tables() -> list[np.ndarray]:
    """Shifts by LANE * 2 ** i bytes, for lengths below 2 ** 40."""
    tables = [SHORT[1024 * LANE :]]
    for _ in range(31):
        tables.append(_by_table(tables[-1], 0, tables[-1]))
    return tables


LONG = _long_tables()
_WHOLE_LANE = [LONG[0][256 * j : 256 * j + 256].tolist() for j in range(4)]


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs after so many zero bytes each, without the complements of CRC-32."""
    out = _by_table(SHORT, 1024 * (lengths % LANE), crcs)
    rest = lengths // LANE
    for table in LONG:
        if not rest.any():
            break
        odd = np.flatnonzero(rest & 1)
        out[odd] = _by_table(table, 0, out[odd])
        rest = rest >> 1
    return out


def prefix_crcs(data: np.ndarray, at: np.ndarray, before: int = 0) -> np.ndarray:
    """CRC-32 of what has CRC ``before`` followed by data[:p], for each p of ``at``."""
    lanes = len(data) // LANE + 1
    padded = np.zeros(lanes * LANE, dtype=np.uint8)
    padded[: len(data)] = data
    steps = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    kept = np.empty((LANE + 1, lanes), dtype=np.uint32)
    state = np.full(lanes, 0xFFFFFFFF, dtype=np.uint32)
    kept[0] = 0
    for k in range(LANE):
        state = BYTE_TABLE[(state ^ steps[k]) & 255] ^ (state >> np.uint32(8))
        np.invert(state, out=kept[k + 1])
    one, two, three, four = _WHOLE_LANE
    crc, starts = before, np.empty(lanes, dtype=np.uint32)
    for i, own in enumerate(kept[LANE].tolist()):
        starts[i] = crc
        crc = one[crc & 255] ^ two[crc >> 8 & 255] ^ three[crc >> 16 & 255] ^ four[crc >> 24] ^ own
    lane, within = at // LANE, at % LANE
    return _by_table(SHORT, 1024 * within, starts[lane]) ^ kept[within, lane]
