"""Streaming over rows sorted by a key, run by run, with bounded memory.

The helper shuffles rows by a key once, sorts them within the partitions and
hands whole Arrow batches to a function, together with the rows that the
function asked to see again. A run of any length passes through in batches, so
that a key with very many rows costs time in proportion but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shopmetrics.llm.lean import lean

Columns = dict[str, np.ndarray]
# (columns, is this the last call of the partition) -> (rows out, rows to see again)
Step = Callable[[Columns, bool], tuple[Columns, Columns]]


def new_run(*columns: np.ndarray) -> np.ndarray:
    """True where any of the sorted columns differs from the row before."""
    change = np.ones(len(columns[0]), dtype=bool)
    if len(change):
        change[1:] = False
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
    return change


def over_sorted(
    df: DataFrame, key: str, order: list[str], step: Step, carried: dict[str, str], schema: str
) -> DataFrame:
    """Rows of ``step`` over ``df`` dealt by ``key`` and sorted by ``order``.

    ``carried`` names further columns (with numpy types) that only rows seen
    again have; they are zero in new rows. Columns must be free of nulls.
    """
    names = df.columns

    def arrays(batch: pa.RecordBatch) -> Columns:
        got = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
        return got | {n: np.zeros(batch.num_rows, dtype=t) for n, t in carried.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: Columns | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = arrays(batch)
            if again is not None:
                columns = {n: np.concatenate([again[n], c]) for n, c in columns.items()}
            out, again = step(columns, False)
            yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in out.items()})
        if again is not None and len(again[key]):
            out, _ = step(again, True)
            yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in out.items()})

    return df.repartition(key).sortWithinPartitions(*order).mapInArrow(lean(run), schema)
