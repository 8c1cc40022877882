"""Exact top-k search by integer inner product, with a ball tree per shard.

Method. Components become floor(64 * x). Vectors are dealt into shards of
about ``SHARD`` by nearest coarse centre (larger groups are cut by a hash), and
each shard has a ball tree: a node has a centre and the radius around it, and
no vector in it scores above q.centre + |q| * radius. A search takes nodes in
order of that bound and stops at the first bound below the k-th best score so
far. A query first searches the shard whose centre scores highest; its k-th
score there then goes along to the other shards, those whose own bound lies
below are never visited, and in the others the search starts from that score.

Coarse centres come from at most ``FIT_VECTORS`` vectors and only decide where
vectors lie; the result is exact whatever they are. The table of shard balls
has one row per ``SHARD`` vectors.

Defined cases: see ``usable_vectors`` for what takes no part; vectors of zeros
do. Scores are exact up to 2**53 and rounded beyond. Ties go to the smaller
vec_id. With fewer than k other vectors all come. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.llm import vectors as V
from shopmetrics.llm.staged import stage_and_release

FIT_VECTORS = 20_000
SHARD = 4096
LEAF = 64
MOST_CENTRES = 1024
QUERY_BLOCK = 2048
# Bounds are widened by this share against rounding.
MARGIN = 1e-9


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None = None
    children: tuple[Node, Node] | None = None


def build(points: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Ball tree; equal points stay in one leaf, whatever their number."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    centre = own.mean(axis=0)
    apart = np.sqrt(((own - centre) ** 2).sum(axis=1))
    node = Node(centre, float(apart.max()))
    if len(rows) > LEAF and node.radius > 0:
        far = own[np.argmax(apart)]
        other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
        side = own @ (other - far)
        low = side < np.median(side)
        if not low.any():  # the median is the smallest value
            low = side <= np.median(side)
        if low.any() and not low.all():
            node.children = (build(points, rows[low]), build(points, rows[~low]))
            return node
    node.rows = np.sort(rows)
    return node


def leaf_bounds(root: Node, queries: np.ndarray, floors: np.ndarray) -> tuple[list[Node], np.ndarray]:
    """Leaves, and what no vector in them scores above (a column for each).

    A query goes down to the children of a node only if the node's bound reaches
    its floor; leaves that it doesn't come to have a bound of minus infinity.
    """
    norms = np.sqrt((queries**2).sum(axis=1))
    leaves: list[Node] = []
    columns: list[np.ndarray] = []
    waiting = [(root, np.arange(len(queries)), np.full(len(queries), np.inf))]
    while waiting:
        node, active, above = waiting.pop()
        value, reach = queries[active] @ node.centre, norms[active] * node.radius
        bound = np.minimum(above, value + reach + MARGIN * (np.abs(value) + reach + 1.0))
        alive = bound >= floors[active]
        active, bound = active[alive], bound[alive]
        if len(active) and node.children:
            waiting += [(child, active, bound) for child in node.children]
        elif len(active):
            leaves.append(node)
            columns.append(np.full(len(queries), -np.inf))
            columns[-1][active] = bound
    return leaves, np.stack(columns, axis=1) if columns else np.zeros((len(queries), 0))


def search(
    root: Node,
    points: np.ndarray,
    ids: np.ndarray,
    queries: np.ndarray,
    own: np.ndarray,
    k: int,
    floors: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's up to k best with a score of at least its floor.

    ``ids`` ascend by row. Each query takes leaves in order of their bounds, in
    rounds of 1, 1, 2, 4, 8 ... leaves, and stops at the first bound below its
    k-th best score; queries that are at the same leaf are scored together.
    """
    floors = floors.astype(np.float64)
    leaves, bounds = leaf_bounds(root, queries, floors)
    order = np.argsort(-bounds, axis=1, kind="stable")
    reach = np.take_along_axis(bounds, order, axis=1)
    query = row = np.zeros(0, dtype=np.int64)
    score = np.zeros(0)
    start = 0
    while start < len(leaves):
        stop = min(len(leaves), max(1, 2 * start))
        asked, turn = np.nonzero(
            (reach[:, start:stop] >= floors[:, None]) & (reach[:, start:stop] > -np.inf)
        )
        if not len(asked):
            break
        at = order[asked, turn + start]
        by_leaf = np.argsort(at, kind="stable")
        asked, at = asked[by_leaf], at[by_leaf]
        found = [(query, row, score)]
        for one in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
            leaf, who = leaves[at[one[0]]], asked[one]
            # Of equal vectors only the smallest ids can come.
            rows = leaf.rows if leaf.radius > 0 else leaf.rows[: k + 1]
            scores = queries[who] @ points[rows].T
            hit, place = np.nonzero(
                (scores >= floors[who][:, None]) & (ids[rows][None] != own[who][:, None])
            )
            found.append((who[hit], rows[place], scores[hit, place]))
        query, row, score = (np.concatenate(x) for x in zip(*found))
        ranked = np.lexsort((row, -score, query))
        query, row, score = query[ranked], row[ranked], score[ranked]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == k - 1
        floors[query[full]] = np.maximum(floors[query[full]], score[full])
        kept = place < k
        query, row, score = query[kept], row[kept], score[kept]
        start = stop
    return query, row, score


def _search_shard(k: int):
    """All queries that visit a shard, over its tree."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        points = V.matrix(vectors.column("vector"))
        asked = V.matrix(queries.column("query"))
        found = np.zeros((3, 0), dtype=np.int64)
        if len(points) and len(asked):
            ids = vectors.column("vec_id").to_numpy()
            order = np.argsort(ids)
            points, ids = points[order], ids[order]
            own = queries.column("query_id").to_numpy()
            floors = queries.column("floor").to_numpy()
            query, row, score = search(build(points), points, ids, asked, own, k, floors)
            found = (own[query], ids[row], score.astype(np.int64))
        names = ("query_id", "vec_id", "score")
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, found)})

    return run


FOUND_SCHEMA = "query_id long, vec_id long, score long"


def _visit(sharded: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Search the shards that queries visit; queries of a shard come in blocks."""
    blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    zero = F.lit(0).cast("long")
    left = sharded.join(blocks, "shard").withColumn(
        "block", F.explode(F.sequence(zero, F.col("blocks") - 1))
    )
    right = visits.join(blocks, "shard").withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))
    )
    return (
        left.select("shard", "block", "vec_id", "vector")
        .groupBy("shard", "block")
        .cogroup(
            right.select("shard", "block", "query_id", "query", "floor").groupBy("shard", "block")
        )
        .applyInArrow(_search_shard(k), FOUND_SCHEMA)
    )


def _ball(table: pa.Table) -> pa.Table:
    """Centre and radius of a shard."""
    points = V.matrix(table.column("vector"))
    centre = points.mean(axis=0)
    radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
    return pa.table(
        {
            "shard": table.column("shard").slice(0, 1),
            "centre": V.lists(centre[None]),
            "radius": [radius],
        }
    )


def exact_top_k(df: DataFrame, every: int = 20, k: int = 20, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose vec_id is divisible by ``every``."""
    spark = df.sparkSession
    whole = F.transform("vector", lambda x: F.floor(x * 64.0).cast("double"))
    vectors = stage_and_release(
        V.usable_vectors(df, nonzero=False).select("vec_id", whole.alias("vector")), "vectors"
    )
    n = vectors.count()
    if n == 0:
        return vectors.select(
            F.col("vec_id").alias("query_id"),
            F.lit(1).alias("rank"),
            "vec_id",
            F.lit(0).cast("long").alias("score"),
        )
    wanted = int(min(MOST_CENTRES, max(1, -(-n // SHARD))))
    centres = V.kmeans(V.sample_vectors(vectors, FIT_VECTORS), wanted, seed)

    def nearest_centre(batches):
        for batch in batches:
            if batch.num_rows:
                near = V.closest(V.matrix(batch.column(1)), centres)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near)], names=["vec_id", "vector", "near"]
                )

    near = vectors.mapInArrow(nearest_centre, "vec_id long, vector array<double>, near long")
    near = stage_and_release(near, "near")
    cuts = near.groupBy("near").agg(F.ceil(F.count("*") / SHARD).alias("cuts"))
    sharded = stage_and_release(
        near.join(cuts, "near").select(
            F.concat_ws("-", "near", F.pmod(F.xxhash64("vec_id"), F.col("cuts"))).alias("shard"),
            "vec_id",
            "vector",
        ),
        "shards",
    )
    balls = stage_and_release(
        sharded.groupBy("shard").applyInArrow(
            _ball, "shard string, centre array<double>, radius double"
        ),
        "balls",
    )
    # One row per shard of SHARD vectors or part of a centre's group.
    table = balls.orderBy("shard").toArrow()
    names = np.array(table.column("shard").to_pylist())
    middle, radius = V.matrix(table.column("centre")), table.column("radius").to_numpy()
    queries = sharded.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.col("vector").alias("query")
    )

    def bounds_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = points @ middle.T
        reach = np.sqrt((points**2).sum(axis=1))[:, None] * radius[None]
        return score, score + reach + MARGIN * (np.abs(score) + reach + 1.0)

    def homes(batches):
        for batch in batches:
            if batch.num_rows:
                home = np.argmax(bounds_of(V.matrix(batch.column(1)))[0], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names[home], pa.string())],
                    names=["query_id", "query", "shard"],
                )

    def others(batches):
        for batch in batches:
            if batch.num_rows:
                floor = batch.column(3).to_numpy(zero_copy_only=False)
                upper = bounds_of(V.matrix(batch.column(1)))[1]
                home = np.array(batch.column(2).to_pylist())
                query, shard = np.nonzero(
                    (upper >= floor[:, None]) & (names[None] != home[:, None])
                )
                taken = pa.array(query)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(taken),
                        batch.column(1).take(taken),
                        pa.array(names[shard], pa.string()),
                        batch.column(3).take(taken),
                    ],
                    names=["query_id", "query", "shard", "floor"],
                )

    schema = "query_id long, query array<double>, shard string"
    spread = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id")
    at_home = stage_and_release(spread.mapInArrow(homes, schema), "home-queries")
    first = stage_and_release(
        _visit(sharded, at_home.withColumn("floor", F.lit(float("-inf"))), k), "home-found"
    )
    ranked = first.withColumn(
        "n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    )
    kth = ranked.where(F.col("n") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    floors = at_home.join(kth, "query_id", "left").withColumn(
        "floor", F.coalesce("floor", F.lit(float("-inf")))
    )
    further = floors.mapInArrow(others, schema + ", floor double")
    return V.best(first.unionByName(_visit(sharded, stage_and_release(further, "visits"), k)), k)
