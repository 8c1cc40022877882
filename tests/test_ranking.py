from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import ranking
from shopmetrics.operators.ranking import (
    average_rank,
    distinct_counts,
    exact_quantiles,
    value_bucket,
    value_part,
    with_prefix,
)


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate(
        [
            rng.lognormal(8, 2, 600).round(0),
            np.full(500, 42.0),
            rng.normal(0, 1, 200).round(1),
            [0.0, -1e9, 1e12, 0.25],
        ]
    )
    groups = rng.choice(["a", "b", "c"], len(values), p=[0.8, 0.19, 0.01])
    pdf = pd.DataFrame({"g": groups, "v": values})
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def test_average_rank_matches_pandas(tied):
    pdf, df = tied
    ranks = with_prefix(distinct_counts(df, "v", ["g"]), "v", ["g"])
    got = {(r.g, r.v): r.rank for r in ranks.withColumn("rank", average_rank()).collect()}
    expected = pdf.groupby("g")["v"].rank(method="average")
    assert all(got[g, v] == e for g, v, e in zip(pdf.g, pdf.v, expected))
    whole = with_prefix(distinct_counts(df, "v", []), "v")
    got = {r.v: (r.rank, r.total) for r in whole.withColumn("rank", average_rank()).collect()}
    expected = pdf["v"].rank(method="average")
    assert all(got[v] == (e, len(pdf)) for v, e in zip(pdf.v, expected))


def test_quantiles_match_numpy(tied):
    pdf, df = tied
    wanted = {"p0": 0.0, "p1": 0.1, "q1": 0.25, "m": 0.5, "q3": 0.75, "p9": 0.999, "top": 1.0}
    for row in exact_quantiles(df, "v", wanted, ["g"]).collect():
        expected = np.quantile(pdf.v[pdf.g == row.g], list(wanted.values()))
        assert [row[n] for n in wanted] == pytest.approx(list(expected), rel=1e-12)
    row = exact_quantiles(df, "v", wanted).first()
    assert list(row) == pytest.approx(list(np.quantile(pdf.v, list(wanted.values()))))


def test_buckets_and_parts_never_decrease(spark):
    rng = np.random.default_rng(3)
    powers = 2.0 ** np.arange(-1074, 1024, 7)
    near = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf)])
    plain = np.concatenate([near, rng.random(500), rng.random(500) / 1000, 1e-300 * rng.random(50), [0.0]])
    values = np.unique(np.concatenate([plain, -plain, [np.inf, -np.inf]]))
    df = spark.createDataFrame([(float(v),) for v in [*values, np.nan]], "v double")
    v = F.col("v")
    keys = [tuple(r) for r in df.orderBy("v").select(value_bucket(v), value_part(v)).collect()]
    assert keys == sorted(keys)
    assert len(set(keys)) > 0.8 * len(values)


@pytest.mark.parametrize("full", [0, 3])
def test_full_buckets_are_split(tied, monkeypatch, full):
    """The same ranks and quantiles when buckets are split by further bits."""
    monkeypatch.setattr(ranking, "FULL", full)
    test_average_rank_matches_pandas(tied)
    test_quantiles_match_numpy(tied)


def test_column_near_zero(spark, monkeypatch):
    """A ratio between 0 and 0.001: no bucket, and no part of a full one, holds many values."""
    monkeypatch.setattr(ranking, "FULL", 20)
    df = spark.range(20_000).select((F.col("id") / 20e6).alias("v"))
    keys = df.select(value_bucket(F.col("v")).alias("b"), value_part(F.col("v")).alias("p"))
    assert keys.groupBy("b").count().agg(F.max("count")).first()[0] < 40
    assert keys.groupBy("b", "p").count().agg(F.max("count")).first()[0] == 1
    clustered = df.select((F.lit(5.0) + F.col("v") / 1000).alias("v"))  # all in one bucket
    assert clustered.select(value_bucket(F.col("v"))).distinct().count() == 1
    placed = with_prefix(distinct_counts(clustered, "v", []), "v").orderBy("v").collect()
    assert [r.before for r in placed] == list(range(20_000))
    middle = exact_quantiles(clustered, "v", {"m": 0.5}).first()["m"]
    assert middle == pytest.approx(5.0 + 9_999.5 / 20e9, abs=1e-13)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(df, "v", {"m": 0.5}, ["g"]).count() == 0
    assert exact_quantiles(df, "v", {"m": 0.5}).first()["m"] is None
