"""Approximate nearest neighbours by inner product with an inverted multi-index.

Method. Each half of a vector is quantised to its nearest of K centroids; the
cell of a vector is the pair of its halves' centroids. A query walks the pairs
by summed distance (the negative inner products of its halves with the
centroids) with a heap, and the vectors of the cells it visits are rescored
exactly. The walk has no fixed length. Each cell's expected share of the
nearest ``k`` follows from its size, its centroid's score and the spread of
the vectors around it; the walk ends when the visited cells hold
``target_recall`` of that sum. A cell answers with the vectors above a floor only,
the score that ``SPARE * k`` vectors are expected to exceed, so that the answers grow
with the queries and not with the cells; queries that get fewer than ``k`` answers so
are asked again without a floor, which makes the result the same as without one. On data without clusters that takes many cells,
on clustered data few, and the recall stays near the target at any size.

K grows with the square root of the number of vectors, up to ``MOST_CENTROIDS``;
centroids and spreads come from at most ``FIT_VECTORS`` vectors, those with the
smallest hash of their id. Every vector is indexed. Cells are cut into slices
of about ``SLICE`` vectors, so that a cell with very many equal vectors is
spread over many tasks; the queries of a slice come in blocks.

Defined cases: see ``usable_vectors`` for what takes no part. A vector of odd
length has the longer half last; vectors of length one have one centroid in
the first half. With fewer than ``k`` other vectors all that are found come.
Ties go to the smaller vec_id. Other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm import vectors as V
from shopmetrics.llm.staged import stage_and_release

FIT_VECTORS = 20_000
MOST_CENTROIDS = 512
CELL_VECTORS = 200
SLICE = 4096
QUERY_BLOCK = 4096
# Times k vectors are expected above the floor of a query's answers.
SPARE = 4


def _tail(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution above z (Abramowitz and Stegun 7.1.26)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    p = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * p * np.exp(-x * x)
    return np.where(z > 0, half, 1 - half)


@dataclass
class MultiIndex:
    """Centroids and spreads of both halves, and the size of each cell."""

    first: np.ndarray
    second: np.ndarray
    first_spread: np.ndarray
    second_spread: np.ndarray
    sizes: np.ndarray | None = None

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, seed: int) -> MultiIndex:
        cut = sample.shape[1] // 2
        halves = []
        for part, own in ((sample[:, :cut], seed), (sample[:, cut:], seed + 1)):
            if part.shape[1] == 0:
                halves.append((np.zeros((1, 0)), np.zeros(1)))
                continue
            centres = V.kmeans(part, k, own)
            near = V.closest(part, centres)
            apart = ((part - centres[near]) ** 2).sum(axis=1)
            count = np.maximum(np.bincount(near, minlength=len(centres)), 1)
            spread = np.bincount(near, apart, len(centres)) / count / part.shape[1]
            halves.append((centres, spread))
        (a, sa), (b, sb) = halves
        return cls(a, b, sa, sb)

    def cells(self, points: np.ndarray) -> np.ndarray:
        cut = self.first.shape[1]
        one = V.closest(points[:, :cut], self.first)
        return one * len(self.second) + V.closest(points[:, cut:], self.second)

    def expected(self, query: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Half scores, each cell's expected number of the nearest k, and the answers' floor."""
        cut = self.first.shape[1]
        one, two = self.first @ query[:cut], self.second @ query[cut:]
        spread = (query[:cut] @ query[:cut]) * self.first_spread[:, None]
        spread = np.sqrt(spread + (query[cut:] @ query[cut:]) * self.second_spread[None] + 1e-18)
        mean = one[:, None] + two[None]
        least = low = float((mean - 9 * spread).min())
        high = float((mean + 9 * spread).max())

        def exceeded(n: int, low: float, high: float, rounds: int) -> float:
            """The score that n vectors are expected to exceed, or a little less."""
            for _ in range(rounds):
                middle = (low + high) / 2
                if (self.sizes * _tail((middle - mean) / spread)).sum() > n:
                    low = middle
                else:
                    high = middle
            return low

        low = exceeded(k, low, high, 40)
        floor = exceeded(SPARE * k, least, low, 12)
        return one, two, self.sizes * _tail((low - mean) / spread), floor

    def walk(self, query: np.ndarray, k: int, target: float) -> tuple[list[int], float]:
        """Filled cells by summed distance until ``target`` of the nearest is expected; the floor."""
        one, two, share, floor = self.expected(query, k)
        wanted = target * share.sum()
        rows, columns = np.argsort(-one), np.argsort(-two)
        heap = [(-(one[rows[0]] + two[columns[0]]), 0, 0)]
        met = {(0, 0)}
        cells: list[int] = []
        held = 0.0
        reached = 0
        while heap and (held < wanted or reached <= k):
            _, i, j = heapq.heappop(heap)
            row, column = rows[i], columns[j]
            if self.sizes[row, column]:
                held += share[row, column]
                reached += int(self.sizes[row, column])
                cells.append(int(row) * len(two) + int(column))
            for i, j in ((i + 1, j), (i, j + 1)):
                if i < len(rows) and j < len(columns) and (i, j) not in met:
                    met.add((i, j))
                    heapq.heappush(heap, (-(one[rows[i]] + two[columns[j]]), i, j))
        return cells, floor


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(V.matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cells)], names=["vec_id", "vector", "cell"]
                )

    return run


def _visits(shared, k: int, target: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = V.matrix(batch.column(1))
            for start in range(0, len(points), 64):
                part = points[start : start + 64]
                cells, floors = zip(*(shared.value.walk(q, k, target) for q in part))
                lengths = np.array([len(c) for c in cells])
                row = np.repeat(np.arange(len(part)), lengths)
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": batch.column(0).slice(start, len(part)).take(pa.array(row)),
                        "cell": pa.array(np.concatenate(cells).astype(np.int64)),
                        "floor": pa.array(np.repeat(floors, lengths)),
                    }
                )

    return run


def _rescore(k: int):
    """Exact scores of a slice's vectors for the queries that visit it, from their floors up."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        points, asked = V.matrix(vectors.column("vector")), V.matrix(queries.column("query"))
        ids = vectors.column("vec_id").to_numpy()
        query_ids = queries.column("query_id").to_numpy()
        floors = queries.column("floor").to_numpy()
        out: list[list[np.ndarray]] = [[np.zeros(0, int), np.zeros(0, int), np.zeros(0)]]
        if len(points) and len(asked):
            order = np.argsort(ids)
            points, ids = points[order], ids[order]
            for start in range(0, len(asked), 256):
                part = asked[start : start + 256]
                scores = part @ points.T
                query, row = V.top_rows(scores, ids, query_ids[start : start + 256], k)
                # The score to report is summed in one order, whatever the block.
                exact = (part[query] * points[row]).sum(axis=1)
                high = exact >= floors[start : start + 256][query]
                query, row, exact = query[high], row[high], exact[high]
                out.append([query_ids[start : start + 256][query], ids[row], exact])
        query_id, vec_id, score = (np.concatenate(c) for c in zip(*out))
        return pa.table(
            {"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": score}
        )

    return run


def nearest(
    df: DataFrame, every: int = 20, k: int = 20, target_recall: float = 0.95, seed: int = 0
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose vec_id is divisible by ``every``."""
    context = df.sparkSession.sparkContext
    vectors = stage_and_release(V.usable_vectors(df, nonzero=True), "vectors")
    n = vectors.count()
    if n == 0:
        return vectors.select(
            F.col("vec_id").alias("query_id"),
            F.lit(1).alias("rank"),
            "vec_id",
            F.lit(0.0).alias("score"),
        )
    centroids = int(min(MOST_CENTROIDS, max(2, round(math.sqrt(n / CELL_VECTORS)))))
    index = MultiIndex.fit(V.sample_vectors(vectors, FIT_VECTORS), centroids, seed)
    celled = stage_and_release(
        vectors.mapInArrow(
            _assign(context.broadcast(index)), "vec_id long, vector array<double>, cell long"
        ),
        "cells",
    )
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"))
    shape = (len(index.first), len(index.second))
    index.sizes = np.zeros(shape, dtype=np.int64)
    for row in sizes.collect():  # at most MOST_CENTROIDS squared
        index.sizes[divmod(row.cell, shape[1])] = row.n
    shared = context.broadcast(index)
    queries = celled.where(F.col("vec_id") % every == 0)
    visits = stage_and_release(
        queries.select("vec_id", "vector")
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "vec_id")
        .mapInArrow(_visits(shared, k, target_recall), "query_id long, cell long, floor double"),
        "visits",
    )

    def answers(visits: DataFrame) -> DataFrame:
        """Scores of the cells' vectors; a slice of a cell meets a block of its queries."""
        load = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
        load = load.join(sizes, "cell").select(
            "cell", "blocks", F.ceil(F.col("n") / SLICE).alias("slices")
        )
        every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        sliced = (
            celled.join(load, "cell")
            .withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")))
            .withColumn("block", every_one(F.col("blocks")))
            .select("cell", "slice", "block", "vec_id", "vector")
        )
        asked = (
            visits.join(load, "cell")
            .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
            .withColumn("slice", every_one(F.col("slices")))
            .join(
                queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")),
                "query_id",
            )
            .select("cell", "slice", "block", "query_id", "query", "floor")
        )
        keys = ["cell", "slice", "block"]
        return (
            sliced.groupBy(*keys)
            .cogroup(asked.groupBy(*keys))
            .applyInArrow(_rescore(k), "query_id long, vec_id long, score double")
        )

    found = stage_and_release(answers(visits), "answers")
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = stage_and_release(visits.join(enough, "query_id", "left_anti"), "short")
    if not short.isEmpty():
        again = answers(short.withColumn("floor", F.lit(float("-inf"))))
        found = found.join(enough, "query_id", "left_semi").unionByName(again)
    return V.best(found, k)
