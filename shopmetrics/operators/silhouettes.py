"""Mean Euclidean silhouette of labellings, with a proven bound, in linear time.

A point's silhouette needs its mean distance to every segment, which pairs all points.
Here the points are gathered in at most about ``LEAVES`` cells instead (up to so many
different points: one cell each, and everything is exact). Cells come from halving the
axes again and again where the points of a cell lie furthest apart. Of each cell,
labelling and segment one row keeps weight, centre and spread (the sum V of squared
distances to the centre). By convexity the n points of a cell are at a summed distance
of at least n times that of their centre, and of at most V / (2 * least distance) more
(or sqrt(n V) where the point is too near to say). So every mean distance lies within known
limits, and so does the mean silhouette: ``low`` and ``high`` are proven, ``silhouette``
lies between them.

A pass over the points serves all labellings; tasks get the cells, the driver gets the
cells' rows, both of bounded number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.schema import SCALED_FEATURES
from shopmetrics.sources.staging import stage

LEAVES = 4096
MAX_LEVEL = 15
# Point and cell distances computed at once.
ENTRIES_AT_ONCE = 1 << 17
WEIGHT, LABELS = "n_points", "labels"
_DIMENSIONS = len(SCALED_FEATURES)


@dataclass
class Cells:
    """Grid cells of several levels, or single points (level -1) by their places."""

    levels: dict[int, np.ndarray]  # ascending keys of the leaves of each level

    def number_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each point; every point lies in one."""
        found = np.full(len(x), -1)
        first = 0
        for level, keys in self.levels.items():
            if len(keys):
                own = grid_keys(x, level)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                found = np.where((found < 0) & (keys[at] == own), first + at, found)
            first += len(keys)
        return found

    def reach(self) -> np.ndarray:
        """Longest distance between two places of each leaf."""
        return np.concatenate(
            [np.full(len(k), np.sqrt(_DIMENSIONS) / 2**level) for level, k in self.levels.items()]
        )


def grid_keys(x: np.ndarray, level: int) -> np.ndarray:
    """Number of the cell of a grid with 2 ** level cells an axis."""
    places = np.clip((x * 2**level).astype(np.int64), 0, 2**level - 1)
    key = places[:, 0]
    for j in range(1, x.shape[1]):
        key = (key << level) | places[:, j]
    return key


def _parents(keys: np.ndarray, level: int) -> np.ndarray:
    parts = [((keys >> (level * (_DIMENSIONS - 1 - j))) & (2**level - 1)) >> 1 for j in range(_DIMENSIONS)]
    key = parts[0]
    for part in parts[1:]:
        key = (key << (level - 1)) | part
    return key


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([batch.column(i).to_numpy() for i in range(_DIMENSIONS)], axis=1)
    return x, batch.column(_DIMENSIONS).to_numpy().astype(float)


_SUMS = ["n", *[f"s{j}" for j in range(_DIMENSIONS)], "q"]
_SUMS_SCHEMA = "key long, " + ", ".join(f"{n} double" for n in _SUMS)


def _grouped(keys: np.ndarray, x: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Weight, weighted coordinates and squared norms by key."""
    own, group = np.unique(keys, return_inverse=True)
    terms = [weight, *(weight * x[:, j] for j in range(_DIMENSIONS)), weight * (x**2).sum(axis=1)]
    return pa.RecordBatch.from_pydict(
        {"key": own} | {n: np.bincount(group, t, len(own)) for n, t in zip(_SUMS, terms)}
    )


def _sums(points: DataFrame, run, columns: list[str]) -> np.ndarray:
    """Rows (key, sums), ascending, of a map task that groups within its batches."""
    rows = (
        points.select(*SCALED_FEATURES, WEIGHT, *columns)
        .mapInArrow(run, _SUMS_SCHEMA)
        .groupBy("key")
        .agg(*[F.sum(n).alias(n) for n in _SUMS])
        .collect()  # a row for each cell (and label), of which there are boundedly many
    )
    return np.array(sorted(map(tuple, rows)), dtype=float).reshape(len(rows), -1)


def _spread(sums: np.ndarray) -> np.ndarray:
    """V of rows (n, s, q)."""
    return np.maximum(sums[:, -1] - (sums[:, 1:-1] ** 2).sum(axis=1) / sums[:, 0], 0)


def build_cells(points: DataFrame, leaves: int = LEAVES) -> Cells:
    """Cells that together hold all points, halved where the spread is largest."""
    levels: dict[int, np.ndarray] = {}
    opened = np.zeros(1, dtype=np.int64)  # the one cell of level 0
    closed = 0
    least = None
    for level in range(1, MAX_LEVEL + 1):
        parents = opened

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, weight = _arrays(batch)
                keys = grid_keys(x, level)
                above = _parents(keys, level)
                at = np.minimum(np.searchsorted(parents, above), len(parents) - 1)
                own = parents[at] == above
                if own.any():
                    yield _grouped(keys[own], x[own], weight[own])

        sums = _sums(points, run, [])
        if not len(sums):
            break
        keys, spread = sums[:, 0].astype(np.int64), _spread(sums[:, 1:])
        if least is None:
            least = spread.sum() / leaves**1.5
        # The widest cells are opened while their children (2 to 16 each) leave room.
        order = np.argsort(-spread, kind="stable")
        room = max(0, leaves - closed - len(keys)) // 4
        wide = order[:room] if level < MAX_LEVEL else order[:0]
        wide = wide[spread[wide] > least]
        kept = np.ones(len(keys), dtype=bool)
        kept[wide] = False
        levels[level] = np.sort(keys[kept])
        closed += int(kept.sum())
        opened = np.sort(keys[~kept])
        if not len(opened):
            break
    return Cells(levels)


def _entries(points: DataFrame, cells: Cells | None, sizes: list[int]) -> list[np.ndarray]:
    """Of each labelling its rows (label, n, centre, V, reach), by label."""
    if cells is None:  # each point is its own cell
        rows = points.select(*SCALED_FEATURES, WEIGHT, LABELS).collect()  # LEAVES at most
        x = np.array([r[:_DIMENSIONS] for r in rows], dtype=float)
        labels = np.array([r[LABELS] for r in rows])
        weight = np.array([r[WEIGHT] for r in rows], dtype=float)
        zero = np.zeros(len(rows))
        found = []
        for i in range(len(sizes)):
            order = np.argsort(labels[:, i], kind="stable")
            found.append(np.column_stack([labels[:, i], weight, x, zero, zero])[order])
        return found
    most = max(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, weight = _arrays(batch)
            labels = batch.column(_DIMENSIONS + 1).flatten().to_numpy().reshape(len(x), -1)
            leaf = cells.number_of(x)
            for i in range(len(sizes)):
                yield _grouped((leaf * len(sizes) + i) * most + labels[:, i], x, weight)

    sums = _sums(points, run, [LABELS])
    keys = sums[:, 0].astype(np.int64)
    label, which, leaf = keys % most, keys // most % len(sizes), keys // most // len(sizes)
    centre = sums[:, 2:-1] / sums[:, 1:2]
    # A cell of one point has no spread but what rounding leaves.
    rows = np.column_stack([label, sums[:, 1], centre, _spread(sums[:, 1:]), cells.reach()[leaf]])
    found = []
    for i in range(len(sizes)):
        own = rows[which == i]
        found.append(own[np.argsort(own[:, 0], kind="stable")])
    return found


class _Summer:
    """Summed distances from points to the points of each label of one labelling."""

    def __init__(self, entries: np.ndarray):
        self.values, heads = np.unique(entries[:, 0].astype(int), return_index=True)
        n, spread = entries[:, 1], entries[:, -2]
        self.total = np.add.reduceat(n, heads)
        self.centre = np.ascontiguousarray(entries[:, 2:-2].T)
        self.norm = (self.centre**2).sum(axis=0)
        self.reach, self.half, self.most = entries[:, -1], spread / 2, np.sqrt(n * spread)
        self.exact = not spread.any()
        # One column for each label, to add entries up by label.
        self.of_label = (entries[:, :1] == self.values).astype(float)
        self.weights = self.of_label * n[:, None]

    def limits(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Least, likely and greatest sum of each point (row) for each label (column)."""
        distance = x @ self.centre
        distance *= -2
        distance += self.norm
        distance += (x**2).sum(axis=1)[:, None]
        np.sqrt(np.maximum(distance, 0, out=distance), out=distance)
        low = distance @ self.weights
        if self.exact:
            return low, low, low
        more = np.maximum(distance - self.reach, 1e-300)
        np.minimum(np.divide(self.half, more, out=more), self.most, out=more)
        # Spread alike in all directions: all but the one towards the point add to the distance.
        likely = np.maximum(distance, 1e-300, out=distance)
        np.divide(self.half, likely, out=likely)
        likely *= (_DIMENSIONS - 1) / _DIMENSIONS
        np.minimum(likely, more, out=likely)
        return low, low + likely @ self.of_label, low + more @ self.of_label


def _score(inside: np.ndarray, outside: np.ndarray) -> np.ndarray:
    most = np.maximum(inside, outside)
    return np.where(most == 0, 0, (outside - inside) / np.where(most == 0, 1, most))


def _add_scores(entries: list[np.ndarray]):
    """Map task: weight and least, likely and greatest sum of silhouettes of each labelling."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summers = [_Summer(own) for own in entries]
        found = np.zeros((len(entries), 4))
        for batch in batches:
            every, weights = _arrays(batch)
            labels = batch.column(_DIMENSIONS + 1).flatten().to_numpy().reshape(len(every), -1)
            for i, own in enumerate(summers):
                step = max(1, ENTRIES_AT_ONCE // len(own.norm))
                for first in range(0, len(every), step):
                    part = slice(first, first + step)
                    weight = weights[part]
                    at = np.searchsorted(own.values, labels[part, i])
                    rows = np.arange(len(at))
                    alone = own.total[at] <= 1
                    others = np.where(alone, 1, own.total[at] - 1)
                    sums = own.limits(every[part])
                    inside = [s[rows, at] / others for s in sums]
                    outside = []
                    for s in sums:
                        means = s / own.total
                        means[rows, at] = np.inf
                        outside.append(means.min(axis=1))
                    for j, (a, b) in enumerate(zip(reversed(inside), outside)):
                        if len(own.values) > 1:
                            found[i, j + 1] += (weight * np.where(alone, 0, _score(a, b))).sum()
                    found[i, 0] += weight.sum()
        yield pa.RecordBatch.from_pydict(
            {"labelling": np.arange(len(entries))}
            | {n: found[:, j] for j, n in enumerate(("n", "low", "likely", "high"))}
        )

    return run


@dataclass
class Silhouette:
    n_segments: int
    low: float | None
    silhouette: float | None
    high: float | None


def euclidean_silhouettes(
    points: DataFrame, sizes: list[int], leaves: int = LEAVES
) -> list[Silhouette]:
    """One result for each labelling of written points.

    ``points`` has the scaled features, their weight ``n_points`` and an array
    ``labels`` with a label (from 0, below ``sizes``) for each labelling. Points alone in their segment
    score 0; a single segment has no silhouette.
    """
    n = points.count()
    if not n:
        return [Silhouette(0, None, None, None) for _ in sizes]
    entries = _entries(points, None if n <= leaves else build_cells(points, leaves), sizes)
    rows = (
        points.select(*SCALED_FEATURES, WEIGHT, LABELS)
        .mapInArrow(_add_scores(entries), "labelling long, n double, low double, likely double, high double")
        .groupBy("labelling")
        .agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in ("low", "likely", "high")])
        .collect()  # a row for each labelling
    )
    found = []
    for r, own in zip(sorted(rows), entries):
        segments = len(np.unique(own[:, 0]))
        figures = (r.low, r.likely, r.high) if segments > 1 else (None, None, None)
        found.append(Silhouette(segments, *figures))
    return found


def euclidean_silhouette(df: DataFrame, label: str = "segment", leaves: int = LEAVES) -> DataFrame:
    """One row: mean Euclidean silhouette of a labelling and its proven limits.

    Up to ``leaves`` different points it is exact. The labels' values are collected.
    """
    values = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(label)) - 1
    points = (
        df.groupBy(*SCALED_FEATURES, place.cast("int").alias("place"))
        .agg(F.count(F.lit(1)).alias(WEIGHT))
        .withColumn(LABELS, F.array("place"))
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (found,) = euclidean_silhouettes(
        stage(points.repartition(parts), "labelled-points"), [max(len(values), 1)], leaves
    )
    return df.sparkSession.createDataFrame(
        [(found.n_segments, found.silhouette, found.low, found.high)],
        "n_segments long, silhouette double, low double, high double",
    )
