from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmetrics import fixed_values as V
from shopmetrics.operators import score, segments, silhouettes
from shopmetrics.schema import SCALED_FEATURES


@pytest.fixture(scope="module")
def blobs(products):
    """Three well separated kinds of products."""
    rng = np.random.default_rng(11)
    kinds = [(10.0, 4.5, 900, 0.1), (500.0, 2.0, 100, 0.5), (950.0, 4.8, 500, 0.9)]
    rows = [
        {
            "price": float(p + rng.normal(0, 5)),
            "rating": float(np.clip(r + rng.normal(0, 0.05), 0, 5)),
            "units_sold": int(u + rng.integers(0, 10)),
            "discount_ratio": float(np.clip(d + rng.normal(0, 0.01), 0, 1)),
        }
        for p, r, u, d in kinds
        for _ in range(25)
    ]
    return score.value_score(score.scale_features(products(rows))).cache()


def test_scaling(products):
    df = products([{"price": p, "rating": 3.0, "units_sold": u} for p, u in [(10.0, 0), (20.0, 5), (30.0, 10)]])
    rows = score.scale_features(df).orderBy("product_id").collect()
    assert [r.price_scaled for r in rows] == [1.0, 0.5, 0.0]
    assert [r.units_sold_scaled for r in rows] == [0.0, 0.5, 1.0]
    assert {r.rating_scaled for r in rows} == {0.0}
    flat = score.value_score(products([{}, {}])).first()
    assert flat.price_scaled == 1.0 and flat.value_score == pytest.approx(40.0)


def test_weights():
    assert score.check_weights(None) == V.SCORE_WEIGHTS
    assert score.check_weights({}) == V.SCORE_WEIGHTS
    with pytest.raises(ValueError):
        score.check_weights({"price": 0.5, "rating": 0.6, "units_sold": 0.0, "discount_ratio": 0.0})
    with pytest.raises(ValueError):
        score.check_weights({"price": 0.5, "rating": 0.5})


def test_scores_within_bounds(blobs):
    row = score.score_range(blobs).first()
    assert 0 <= row.min_score <= row.mean_score <= row.max_score <= 100


def test_missing_feature_is_an_error(products):
    with pytest.raises(ValueError):
        score.scale_features(products([{}]).drop("rating"))


def test_k_table_picks_the_true_number(blobs):
    rows = segments.k_table(blobs, k_max=5, restarts=3).collect()
    assert [r.k for r in rows] == [2, 3, 4, 5]
    assert [r.k for r in rows if r.best] == [3]
    inertia = [r.inertia for r in rows]
    assert inertia == sorted(inertia, reverse=True)
    with pytest.raises(ValueError):
        segments.k_table(blobs.limit(2), restarts=1)


def test_segments_are_nearest_and_repeatable(blobs):
    first = segments.segment_products(blobs, restarts=2).cache()
    again = segments.segment_products(blobs, restarts=2)
    pairs = first.select("product_id", "segment")
    assert sorted(map(tuple, pairs.collect())) == sorted(
        map(tuple, again.select("product_id", "segment").collect())
    )
    means = first.groupBy("segment").agg(F.avg("price").alias("p")).orderBy("segment").collect()
    assert [m.segment for m in means] == [0, 1, 2]
    assert [m.p for m in means] == sorted(m.p for m in means)
    centres = first.groupBy("segment").agg(*[F.avg(n).alias(n) for n in SCALED_FEATURES])
    at = [(r.segment, [r[n] for n in SCALED_FEATURES]) for r in centres.collect()]
    nearest = segments.assign_segments(first.withColumnRenamed("segment", "kept"), at)
    assert nearest.filter("segment <> kept").count() == 0


def test_more_restarts_never_cost_more(blobs):
    few = segments.k_table(blobs, k_min=4, k_max=4, restarts=1).first().inertia
    many = segments.k_table(blobs, k_min=4, k_max=4, restarts=4).first().inertia
    assert many <= few + 1e-9


def plain_lloyd(x, centres, moves):
    for step in range(moves + 1):
        label = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        cost = ((x - centres[label]) ** 2).sum()
        if step < moves:
            centres = np.array([x[label == i].mean(0) if (label == i).any() else c for i, c in enumerate(centres)])
    return cost, label


def plain_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    if len(set(label)) < 2:
        return None
    values = []
    for i, own in enumerate(label):
        same = label == own
        if same.sum() == 1:
            values.append(0.0)
            continue
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][label == o].mean() for o in set(label) - {own})
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(values))


def labelled_table(spark, x, label):
    rows = [(int(i), *map(float, v)) for i, v in zip(label, x)]
    return spark.createDataFrame(rows, "segment int, " + ", ".join(f"{n} double" for n in SCALED_FEATURES))


@pytest.mark.parametrize("leaves", [20, 100, 4096])
def test_euclidean_silhouette_within_its_limits(spark, leaves):
    """Repeated points, a segment of one, points on cell edges and a hot cell."""
    rng = np.random.default_rng(4)
    x = np.concatenate([
        rng.random((250, 4)), np.full((150, 4), 0.3) + rng.normal(0, 0.002, (150, 4)),
        rng.choice([0.0, 0.25, 0.5, 1.0], (100, 4)), np.full((60, 4), 0.5),
    ])
    label = np.where(x[:, 0] < 0.35, 7, np.where(x[:, 1] < 0.5, 2, 4))
    label[0] = 9
    row = silhouettes.euclidean_silhouette(labelled_table(spark, x, label), leaves=leaves).first()
    want = plain_silhouette(x, label)
    assert row.n_segments == 4 and row.low - 1e-9 <= want <= row.high + 1e-9
    assert row.low <= row.silhouette <= row.high
    assert row.silhouette == pytest.approx(want, abs={20: 0.1, 100: 0.03, 4096: 1e-7}[leaves])
    if leaves == 4096:
        assert row.low == row.high


def test_euclidean_silhouette_of_one_segment(spark):
    df = labelled_table(spark, np.random.default_rng(1).random((5, 4)), [1] * 5)
    assert tuple(silhouettes.euclidean_silhouette(df).first()) == (1, None, None, None)
    assert silhouettes.euclidean_silhouette(df.limit(0)).first().n_segments == 0


def test_moves_from_given_centres(blobs):
    """Several models in one scan; weights of repeated products; a centre without points stays."""
    twice = blobs.union(blobs)
    starts = [[[0.1] * 4, [0.9] * 4], [[0.2] * 4, [0.5] * 4, [9.0] * 4], [[0.3, 0.3, 0.3, 0.4]]]
    rows = segments.k_table_from_starts(twice, starts, 4).collect()
    x = twice.select(*SCALED_FEATURES).toPandas().to_numpy()
    for row, centres in zip(rows, starts):
        cost, label = plain_lloyd(x, np.array(centres), 4)
        assert row.k == len(centres) and row.inertia == pytest.approx(cost, rel=1e-9)
        want = plain_silhouette(x, label)
        assert row.silhouette == (None if want is None else pytest.approx(want, abs=1e-9))


def test_fits_are_as_good_as_separate_ones(blobs):
    ml = pytest.importorskip("pyspark.ml.clustering")
    feature = pytest.importorskip("pyspark.ml.feature")
    table = {r.k: r.inertia for r in segments.k_table(blobs, k_max=4).collect()}
    vectors = feature.VectorAssembler(inputCols=SCALED_FEATURES, outputCol="features").transform(blobs)
    for k in (2, 3, 4):
        fits = [ml.KMeans(k=k, seed=s, maxIter=300).fit(vectors).summary.trainingCost for s in range(42, 46)]
        assert table[k] <= min(fits) * (1 + 1e-6)


def test_fewer_points_than_segments(products):
    """Equal products are one point: larger sizes are left out."""
    df = score.value_score(score.scale_features(products([{"price": float(i % 3)} for i in range(12)])))
    assert [r.k for r in segments.k_table(df, restarts=2).collect()] == [2, 3]
    with pytest.raises(ValueError):
        segments.segment_products(df, k=4)


def test_silhouette_against_pairs(blobs):
    labelled = blobs.withColumn("segment", F.col("product_id").cast("int") % 4)
    labelled = labelled.withColumn("segment", F.when(F.col("product_id") == "0", 9).otherwise(F.col("segment")))
    pdf = labelled.toPandas()
    x, label = pdf[SCALED_FEATURES].to_numpy(), pdf["segment"].to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    values = []
    for i, own in enumerate(label):
        if (label == own).sum() == 1:
            values.append(0.0)
            continue
        a = d[i][label == own].sum() / ((label == own).sum() - 1)
        b = min(d[i][label == o].mean() for o in set(label) - {own})
        values.append((b - a) / max(a, b))
    row = segments.silhouette(labelled).first()
    assert row.n_segments == 5 and row.silhouette == pytest.approx(np.mean(values), abs=1e-9)
    alone = labelled.withColumn("segment", F.lit(0))
    assert segments.silhouette(alone).first().silhouette is None


def labelled_rows(products, rows):
    """Rows of (segment, price, rating, value_score)."""
    df = products([{"price": p, "rating": r} for _, p, r, _ in rows])
    extra = df.sparkSession.createDataFrame(
        [(str(i), s, float(v)) for i, (s, _, _, v) in enumerate(rows)],
        "product_id string, segment int, value_score double",
    )
    return df.join(extra, "product_id")


@pytest.mark.parametrize(
    "k, tiers",
    [
        (1, ["Tầm trung"]),
        (2, ["Rẻ", "Đắt"]),
        (3, ["Rẻ", "Tầm trung", "Đắt"]),
        (4, ["Rẻ", "Rẻ", "Tầm trung", "Đắt"]),
        (8, ["Rẻ"] * 3 + ["Tầm trung"] * 3 + ["Đắt"] * 2),
    ],
)
def test_price_tiers(products, k, tiers):
    df = labelled_rows(products, [(s, float(s + 1), 3.0, 0.0) for s in range(k)])
    rows = segments.segment_price_tier(df).orderBy("segment").collect()
    assert [r.tier for r in rows] == tiers


def test_names_and_repeats(products):
    rows = [
        (0, 1.0, 3.0, 10.0), (1, 2.0, 4.0, 20.0), (2, 3.0, 4.0, 30.0),
        (3, 4.0, 1.0, 1.0), (4, 5.0, 2.0, 2.0), (5, 6.0, 1.0, 3.0), (6, 7.0, 5.0, 4.0),
    ]
    df = labelled_rows(products, rows)
    names = {r.segment: r.segment_name for r in segments.dedup_segment_names(df).collect()}
    assert names == {
        0: "Rẻ - Đáng ngờ",
        1: "Rẻ - Đáng tin (nhóm 2)",
        2: "Rẻ - Đáng tin (nhóm 1)",
        3: "Tầm trung - Cần xem xét",
        4: "Tầm trung - Ổn định",
        5: "Đắt - Cần cân nhắc",
        6: "Đắt - Xắt ra miếng",
    }
    profile = segments.segment_profile(df).collect()
    assert [r.segment for r in profile] == [2, 1, 0, 6, 5, 4, 3]
    assert profile[0].description == V.SEGMENT_DESCRIPTIONS["Rẻ", True]
    badge = segments.with_segment_names(df).select(segments.segment_badge(F.col("segment_name")).alias("b"))
    assert "Đáng tin (nhóm 1)" in {r.b for r in badge.collect()}


def test_badge_without_separator(spark):
    df = spark.createDataFrame([("plain",), ("a - b - c",)], "n string")
    assert [r[0] for r in df.select(segments.segment_badge(F.col("n"))).collect()] == ["plain", "b"]
