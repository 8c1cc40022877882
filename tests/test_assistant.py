from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import assistant, prefix_topk


def advised(products, rows):
    scores = [row.pop("value_score", 0.0) for row in rows]
    df = products(rows)
    spark = df.sparkSession
    ids = [row.get("product_id", str(i)) for i, row in enumerate(rows)]
    extra = spark.createDataFrame(list(zip(ids, scores)), "product_id string, value_score double")
    return df.join(extra, "product_id").withColumns(
        {"segment": F.lit(0), "segment_name": F.lit("Rẻ - Đáng tin")}
    )


def brute_alternatives(pdf, tolerance=0.5):
    answers = {}
    for row in pdf.itertuples():
        cheaper = pdf[(pdf.category == row.category) & (pdf.price < row.price)]
        strict = cheaper[cheaper.rating >= row.rating - tolerance]
        relaxed = len(strict) < 3 and len(cheaper) > len(strict)
        pool = cheaper if relaxed else strict
        best = pool.sort_values(["value_score", "product_id"], ascending=[False, True]).head(3)
        answers[row.product_id] = (list(best.product_id), relaxed)
    return answers


def random_rows(n, prices, ratings, seed, hot=0.4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        hot_row = rng.random() < hot
        rows.append(
            {
                "product_id": f"p{i:05d}",
                "category": "hot" if hot_row else f"c{rng.integers(4)}",
                "price": float(rng.choice(prices)),
                "rating": float(rng.choice(ratings)),
                "value_score": float(rng.integers(0, 30)),
            }
        )
    return rows


@pytest.mark.parametrize(
    "prices, ratings, served",
    [
        (np.arange(1, 12), np.arange(0, 5.1, 0.5), 10),
        (np.arange(1, 400), np.arange(0, 5.01, 0.1).round(1), 2),
        (np.array([7.0]), np.array([3.0]), 10),
        (np.linspace(1, 2, 300), np.linspace(0, 5, 200), 0),
    ],
)
def test_alternatives_match_brute_force(products, monkeypatch, prices, ratings, served):
    monkeypatch.setattr(prefix_topk, "LEVEL_SERVED", served)
    rows = random_rows(350, prices, ratings, seed=len(prices))
    pdf = pd.DataFrame(rows)
    df = advised(products, rows)
    got: dict = {}
    for r in assistant.cheaper_alternatives(df).orderBy("product_id", "place").collect():
        ids, _ = got.setdefault(r.product_id, ([], r.relaxed))
        ids.append(r.alt_id)
    expected = {k: v for k, v in brute_alternatives(pdf).items() if v[0]}
    assert got == expected


def test_alternative_notes(products):
    df = advised(
        products,
        [
            {"price": 10.0, "rating": 5.0, "value_score": 1.0},
            {"price": 9.0, "rating": 5.0, "value_score": 2.0},
            {"price": 8.0, "rating": 3.0, "value_score": 3.0},
            {"price": 7.0, "rating": 3.0, "value_score": 4.0},
            {"price": 7.0, "rating": 3.0, "value_score": 4.0},
        ],
    )
    notes = {
        r.product_id: (r.n_alternatives, r.alternatives_note)
        for r in assistant.alternative_notes(df, assistant.cheaper_alternatives(df)).collect()
    }
    relaxed = "Cùng ngành hàng, rẻ hơn (đã nới điều kiện rating do ít lựa chọn)."
    strict = "Cùng ngành hàng, rẻ hơn, rating tương đương."
    assert notes["0"] == (3, relaxed)
    assert notes["1"] == (3, relaxed)
    assert notes["2"] == (2, strict + " Chỉ tìm được 2/3 lựa chọn phù hợp trong dữ liệu.")
    assert notes["3"] == (0, "Không tìm thấy sản phẩm nào rẻ hơn trong ngành 'A' trong tập dữ liệu hiện có.")
    first = assistant.cheaper_alternatives(df).filter("product_id = '0' and place = 1").first()
    assert (first.alt_id, first.pct_cheaper) == ("3", pytest.approx(30.0))


def test_percentile(products):
    df = products(
        [{"price": p, "category": "A"} for p in (1.0, 2.0, 2.0, 3.0, 4.0, 5.0)]
        + [{"price": 1.0, "category": "B"}] * 4
    )
    got = {r.product_id: r for r in assistant.price_percentile(df).collect()}
    assert [got[str(i)].price_percentile for i in range(6)] == [0.0, 16.7, 16.7, 50.0, 66.7, 83.3]
    assert got["3"].percentile_note == "50% trong tổng số 6 sản phẩm cùng ngành 'A' rẻ hơn."
    assert got["7"].price_percentile is None
    assert "chỉ có 4 sản phẩm" in got["7"].percentile_note


def test_evaluate(products):
    df = advised(products, [{"price": float(p), "value_score": float(p)} for p in (1, 2, 3, 4, 5, 6)])
    row = assistant.evaluate_product(df, "5").first()
    assert [a.product_id for a in row.alternatives] == ["4", "3", "2"]
    assert (row.price_percentile, row.value_score, row.segment) == (83.3, 6.0, 0)
    cheapest = assistant.evaluate_product(df, "0").first()
    assert cheapest.alternatives is None and cheapest.alternatives_note.startswith("Không tìm thấy")
    with pytest.raises(ValueError):
        assistant.evaluate_product(df, "99")
    asked = df.sparkSession.createDataFrame([("3",), ("99",)], "product_id string")
    assert [r.product_id for r in assistant.evaluate_products(df, asked).collect()] == ["3"]
    assert [r.product_id for r in assistant.unknown_products(df, asked).collect()] == ["99"]
    with pytest.raises(ValueError):
        assistant.evaluate_products(df.drop("value_score"))


def test_budget_search(products):
    df = advised(
        products,
        [
            {"price": 10.0, "value_score": 5.0, "category": "A"},
            {"price": 20.0, "value_score": 9.0, "category": "B"},
            {"price": 20.5, "value_score": 99.0, "category": "A"},
            {"price": 5.0, "value_score": 5.0, "category": "A"},
        ],
    )
    ids = lambda found: [r.product_id for r in found.collect()]
    assert ids(assistant.recommend_under_budget(df, 20.0)) == ["1", "0", "3"]
    assert ids(assistant.recommend_under_budget(df, 20.0, "A", 1)) == ["0"]
    empty = assistant.recommend_under_budget(df, 1.0)
    assert empty.columns == assistant.RECOMMENDATION_COLUMNS and empty.count() == 0
    with pytest.raises(ValueError):
        assistant.recommend_under_budget(df, 0)


def test_batch_equals_single_searches(products, monkeypatch):
    monkeypatch.setattr(prefix_topk, "LEVEL_SERVED", 1)
    df = advised(products, random_rows(200, np.arange(1, 60), np.arange(0, 5, 0.5), 3)).cache()
    requests = [(1, 30.0, None), (2, 30.0, "hot"), (3, 0.5, "hot"), (4, 1e9, None), (5, 1e9, "c1"),
                (6, 12.5, "c2"), (7, 10.0, "missing"), (8, -4.0, None), (9, 1e9, None), (10, 1.0, "hot")]
    table = df.sparkSession.createDataFrame(requests, "request_id bigint, budget double, category string")
    got: dict = {}
    for r in assistant.recommend_batch(df, table, n=4).orderBy("request_id", "place").collect():
        got.setdefault(r.request_id, []).append(r.product_id)
    for number, budget, category in requests:
        if budget <= 0:
            assert number not in got
            continue
        single = assistant.recommend_under_budget(df, budget, category, 4)
        assert got.get(number, []) == [r.product_id for r in single.collect()]


def test_reasons(products):
    df = advised(
        products,
        [
            {"price": 50.0, "rating": 5.0, "units_sold": 100},
            {"price": 30.0, "rating": 4.0, "units_sold": 1},
            {"price": 25.0, "rating": 4.5, "units_sold": 2, "category": "B"},
            {"price": 25.0, "rating": 1.0, "units_sold": 3, "category": "C"},
            {"price": 25.0, "rating": 2.0, "units_sold": 2, "category": "C"},
            {"price": 25.0, "rating": 3.0, "units_sold": 1, "category": "C"},
        ],
    )
    found = assistant.recommend_under_budget(df, 100.0, n=10)
    got = {r.product_id: r.reason for r in assistant.explain_recommendations(found, df, 100.0).collect()}
    assert got["0"] == "💡 Rẻ hơn ngân sách 50%, đánh giá cao vượt trội (5.0 ⭐ so với TB 4.5), và thuộc top bán chạy (100 lượt)."
    assert got["1"] == "💡 Rẻ hơn ngân sách 70%, mức đánh giá an toàn (4.0 ⭐)."
    assert got["2"] == "💡 Rẻ hơn ngân sách 75%, mức đánh giá an toàn (4.5 ⭐)."
    assert got["3"] == "💡 Rẻ hơn ngân sách 75%, và thuộc top bán chạy (3 lượt)."
    assert got["4"] == "💡 Rẻ hơn ngân sách 75%."


def test_sample(products):
    rows = assistant.sample_products(products([{} for _ in range(7)])).collect()
    assert [r.product_id for r in rows] == ["0", "1", "2", "3", "4"] and len(rows[0]) == 7


@pytest.mark.parametrize("prices,ratings,kept_share", [(3000, 2000, 0.2), (3000, 30, 0.2), (20, 5, 1.0)])
def test_skyband_keeps_whoever_can_be_among_the_best(spark, prices, ratings, kept_share):
    rng = np.random.default_rng(prices + ratings)
    n = 3000
    rows = pd.DataFrame(
        {
            "category": np.where(np.arange(n) < n - 4, "hot", "cold"),
            "price_position": rng.integers(0, prices, n),
            "rating_position": rng.integers(0, ratings, n),
            "minus_score": -rng.integers(0, 200, n).astype(float),
            "product_id": np.arange(n),
        }
    )
    frame = spark.createDataFrame(rows).select(
        "category",
        "price_position",
        F.lit(prices - 1).cast("long").alias("price_top"),
        "rating_position",
        F.lit(ratings - 1).cast("long").alias("rating_top"),
        F.struct("minus_score", "product_id").alias("entry"),
    )
    axes = [
        prefix_topk.Axis("price_position", "price_position", "price_top"),
        prefix_topk.Axis("rating_position", "rating_position", "rating_top"),
    ]
    found = prefix_topk.skyband(frame, ["category"], axes, 3)
    assert found.columns == frame.columns
    ids = [r[0] for r in found.select("entry.product_id").collect()]
    kept = set(ids)
    assert len(kept) == len(ids)

    hot = rows[rows.category == "hot"]
    price, rating = hot.price_position.to_numpy(), hot.rating_position.to_numpy()
    rank = hot[["minus_score", "product_id"]].apply(tuple, axis=1).rank().to_numpy()
    for at, product in enumerate(hot.product_id):
        outdone = (price <= price[at]) & (rating <= rating[at]) & (rank < rank[at])
        assert product in kept or outdone.sum() >= 3
    assert set(range(n - 4, n)) <= kept or prices < 3000
    assert len(kept) <= kept_share * n
