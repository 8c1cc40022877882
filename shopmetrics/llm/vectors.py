"""Helpers for tables of embedding vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id long, vector array<double>) of the rows that take part.

    Left out: null ids, null or empty vectors, vectors with null or non-finite
    components, with ``nonzero`` those of zeros only, and vectors whose length
    isn't the most frequent one (of several, the smallest). Rows with equal
    ids count once, with the smallest vector.
    """
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).where(
        F.col("vec_id").isNotNull() & (F.size(x) > 0) & fit
    )
    if nonzero:
        rows = rows.where(F.exists("vector", lambda v: v != 0.0))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("n")).count()
    usual = sizes.orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (usual.n if usual else 0))


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def lists(rows: np.ndarray) -> pa.Array:
    """An Arrow list column of the rows of a matrix."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = closest(points, centres)
        sizes = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        if not full.all():
            centres[~full] = points[rng.integers(len(points), size=(~full).sum())]
    return centres


def closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each point."""
    return np.argmax(points @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)


def sample_vectors(vectors: DataFrame, size: int) -> np.ndarray:
    """At most ``size`` vectors, the same in every run: those with the smallest id hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("vector").toArrow()
    return matrix(rows.column("vector"))


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest scores, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_rows(
    scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate row) of each query's k best, without the query itself.

    ``ids`` must ascend, so that of equal scores the smaller id comes first.
    """
    n = scores.shape[1]
    if n > 4 * k:  # what can't be among the best k + 1 goes before sorting
        floor = -np.partition(-scores, k, axis=1)[:, k]
    else:
        floor = np.full(len(scores), -np.inf)
    query, row = np.nonzero(scores >= floor[:, None])
    keep = ids[row] != query_ids[query]
    query, row = query[keep], row[keep]
    order = np.lexsort((row, -scores[query, row], query))
    query, row = query[order], row[order]
    head = np.searchsorted(query, np.arange(len(scores)))
    place = np.arange(len(query)) - head[query]
    return query[place < k], row[place < k]
