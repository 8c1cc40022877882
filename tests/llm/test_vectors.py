"""Searches against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from shopmetrics.llm import ball_tree, multi_index
from shopmetrics.llm.ball_tree import exact_top_k
from shopmetrics.llm.multi_index import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [
        (None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], 0, 1)
        for i, v in zip(ids, vectors)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def brute(vectors: np.ndarray, every: int, k: int) -> dict:
    out = {}
    scores = vectors @ vectors.T
    for q in range(0, len(vectors), every):
        order = [i for i in np.lexsort((np.arange(len(vectors)), -scores[q])) if i != q][:k]
        out[q] = [(int(i), scores[q][i]) for i in order]
    return out


def as_dict(df) -> dict:
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def data(n: int, hot: int) -> np.ndarray:
    rng = np.random.default_rng(n)
    vectors = rng.normal(size=(n, 12)).astype(np.float32)
    vectors[n // 3 : n // 3 + hot] = vectors[0]
    return vectors.astype(float)


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD", 300)
    vectors = data(1500, 500)
    got = as_dict(exact_top_k(table(spark, vectors), every=20, k=20))
    want = brute(np.floor(64 * vectors), 20, 20)
    assert got == {q: [(i, int(s)) for i, s in found] for q, found in want.items()}


def test_tree_search_prunes():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8)) * 50
    points = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 8)))
    points[300:420] = points[0]
    ids, own, k = np.arange(1000), np.arange(0, 1000, 7), 5
    root = ball_tree.build(points)
    scores = points[own] @ points.T
    want = {
        int(q): [i for i in np.lexsort((ids, -scores[j])) if i != q][:k] for j, q in enumerate(own)
    }
    for floors in (np.full(len(own), -np.inf), np.sort(scores, axis=1)[:, -3]):
        query, row, score = ball_tree.search(root, points, ids, points[own], own, k, floors)
        assert (score == scores[query, row]).all()
        for j, q in enumerate(own):
            best = [i for i in want[int(q)] if scores[j, i] >= floors[j]]
            assert row[query == j].tolist() == best
    leaves, bounds = ball_tree.leaf_bounds(root, points[own], np.sort(scores, axis=1)[:, -3])
    assert np.isinf(bounds).mean() > 0.5  # most leaves aren't come to
    for j, leaf in enumerate(leaves):
        met = bounds[:, j] > -np.inf
        assert (scores[met][:, leaf.rows].max(axis=1) <= bounds[met, j]).all()
    above = scores.max(axis=1) + 1
    assert len(ball_tree.search(root, points, ids, points[own], own, k, above)[0]) == 0


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SLICE", 200)
    vectors = data(4000, 100)
    got = as_dict(nearest(table(spark, vectors), every=20, k=20))
    want = brute(vectors, 20, 20)
    assert got.keys() == want.keys() and all(len(f) == 20 for f in got.values())
    hits = 0
    for q, found in got.items():
        # of equal scores any may be met
        floor = want[q][-1][1] - 1e-9
        hits += sum(s >= floor for _, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(s == pytest.approx(vectors[q] @ vectors[i]) and i != q for i, s in found)
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("search", [nearest, exact_top_k])
def test_odd_vectors(spark, search):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [0, 0], None, [nan, 1], [inf, 1], [None, 1], [], [1, 2, 3], [2, 0], [1, 1], [1, 1]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 20, None]
    got = as_dict(search(table(spark, vectors, ids), every=20, k=3))
    assert set(got) == {0, 20}
    with_zero = [1] if search is exact_top_k else []
    assert [i for i, _ in got[0]] == [8, 20, *with_zero]
    assert search(table(spark, vectors[2:7], ids[2:7]), every=20, k=3).count() == 0
    assert search(table(spark, [[1.0]], [0]).limit(0), every=20, k=3).count() == 0


def test_one_component(spark):
    vectors = np.arange(50.0)[:, None] + 1
    got = as_dict(nearest(table(spark, vectors), every=10, k=2))
    assert got[0] == [(49, 50.0), (48, 49.0)]


def test_answers_grow_with_the_queries(spark, monkeypatch):
    """Cells answer from a floor up: far fewer rows than k for each cell visited."""
    staged = {}

    def stage(df, name, real=multi_index.stage_and_release):
        staged[name] = real(df, name)
        return staged[name]

    monkeypatch.setattr(multi_index, "stage_and_release", stage)
    vectors = data(8000, 0)
    got = as_dict(nearest(table(spark, vectors), every=40, k=20))
    visits, answers = staged["visits"].count(), staged["answers"].count()
    assert len(got) == 200 and all(len(found) == 20 for found in got.values())
    assert answers < 200 * 20 * 2 * multi_index.SPARE < visits * 20


def test_queries_below_their_floor_are_asked_again(spark, monkeypatch):
    """Too high a floor changes no result."""
    vectors = data(2000, 300)
    want = as_dict(nearest(table(spark, vectors), every=100, k=20))
    real = multi_index._visits

    def high(*args):
        run = real(*args)

        def raised(batches):
            for batch in run(batches):
                floor = batch.column(2).to_numpy() + 1e6 * (batch.column(0).to_numpy() % 200 == 0)
                yield batch.set_column(2, "floor", pa.array(floor))

        return raised

    monkeypatch.setattr(multi_index, "_visits", high)
    assert as_dict(nearest(table(spark, vectors), every=100, k=20)) == want
