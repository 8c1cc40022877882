"""Packing of documents into training sequences by the sum-of-squares rule.

Method. Documents arrive one after the other; each is cut into full windows
and a rest. A rest goes to the fill level for which the sum of squares of the
numbers of partially filled windows at each level grows least, tracked in an
array with one count per level; a new window is the level zero. The rule keeps
levels about equally used, so that later rests find windows they fill exactly.
When a task's documents end, its open windows are closed: their pieces are
joined in order of fill and cut at the window length, so that at most one
window a task is padded.

A task packs the documents of its own partition in their order: nothing is
shuffled, and a task that runs again gives the same pieces. At most ``length -
1`` levels of open windows are held in memory, with their ids.

Defined cases: a null or empty text is the end id alone. Rows with equal ids
are separate documents. A null doc_id stays null. Other columns aren't read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.tokens import Encoder

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)
# Sequence ids of a task start at its partition number times this.
TASK_SEQUENCES = 1 << 40
ROWS_OUT = 2000

# doc_id, start, ids, doc_tokens
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """Online packer: ``add`` and ``close`` give finished windows of pieces."""

    def __init__(self, length: int):
        self.length = length
        self.counts = np.zeros(length + 1, dtype=np.int64)
        self.open: list[deque[list[Piece]]] = [deque() for _ in range(length)]

    def level(self, size: int) -> int:
        """Fill level to put ``size`` on; zero starts a window."""
        length = self.length
        counts = self.counts[: length - size + 1]
        growth = 2 * self.counts[size:] + 1 - (2 * counts - 1)
        growth[-1] -= 1  # a full window counts no more
        growth[0] -= 1
        if size == length:
            return 0
        usable = counts > 0
        usable[0] = True
        growth[~usable] = np.iinfo(np.int64).max
        return int(length - size - np.argmin(growth[::-1]))

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        total, length = len(ids), self.length
        full = total // length * length
        for start in range(0, full, length):
            yield [(doc, start, ids[start : start + length], total)]
        if full == total:
            return
        rest: Piece = (doc, full, ids[full:].copy(), total)
        size = total - full
        level = self.level(size)
        window = [] if level == 0 else self.open[level].popleft()
        if level:
            self.counts[level] -= 1
        window.append(rest)
        if level + size == length:
            yield window
        else:
            self.open[level + size].append(window)
            self.counts[level + size] += 1

    def close(self) -> Iterator[list[Piece]]:
        """Windows of what is still open, cut where a window is full."""
        window: list[Piece] = []
        room = self.length
        for level in range(self.length - 1, 0, -1):
            for held in self.open[level]:
                for doc, start, ids, total in held:
                    while len(ids):
                        part, ids = ids[:room], ids[room:]
                        window.append((doc, start, part, total))
                        start += len(part)
                        room -= len(part)
                        if room == 0:
                            yield window
                            window, room = [], self.length
        if window:
            yield window


def _pack(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = np.array([end_id], dtype=encoder.dtype)
        packer = SumOfSquares(length)
        sequence = TaskContext.get().partitionId() * TASK_SEQUENCES
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 3
            names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

        def put(windows: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc, start, len(ids), raw, total, sequence, offset))
                    offset += len(ids)
                sequence += 1

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.concatenate([encoder.encode(text.as_py() or ""), end])
                put(packer.add(doc.as_py(), ids))
                if len(rows) >= ROWS_OUT:
                    yield flush()
        put(packer.close())
        if rows:
            yield flush()

    return run


def pack_documents(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: its place in its document and in its sequence.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit
    integers. Sequences have ``length`` ids; what a sequence lacks is padding.
    """
    if length < 2:
        raise ValueError("a sequence has at least two ids")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _pack(path, length, end_id), PIECE_SCHEMA
    )
