from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import clean
from shopmetrics.operators.normalize import normalize_primary
from shopmetrics.operators.prefix_topk import best_per_key


def raw(spark, rows):
    return spark.createDataFrame(
        [(*row, i) for i, row in enumerate(rows)],
        "id string, name string, price double, seller string, arrival int",
    )


def test_dedup_raw_keeps_first_arrived(spark):
    df = raw(spark, [("1", "a", 1.0, "x"), ("1", "b", 2.0, "y"), (None, "c", 3.0, "z"), (None, "d", 4.0, "w")])
    assert sorted(r.name for r in clean.dedup_raw(df).collect()) == ["a", "c"]
    counts = clean.dedup_counts(df).first()
    assert tuple(counts) == (4, 2, 2)
    assert tuple(clean.dedup_counts(df.limit(0)).first()) == (0, 0, 0)


def test_rows_are_dealt_before_they_are_sorted(spark):
    """A map task doesn't sort all it reads, and a hot key has the right first copy."""
    rows = [("hot", f"n{i}", float(i), "x") for i in range(300)] + [(None, "c", 3.0, "z"), ("1", "a", 1.0, "x")]
    kept = clean.dedup_raw(raw(spark, rows[::-1]))
    assert sorted(r.name for r in kept.collect()) == ["a", "c", "n299"]
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    before = plan[plan.index("WindowGroupLimit"):]
    assert "Exchange hashpartitioning(id" in before and f", {clean.DEALT})" in before


def test_zero_priced_first_copy_removes_the_product(spark):
    df = raw(spark, [("1", "a", 0.0, "x"), ("1", "a", 5.0, "x"), ("2", "b", 5.0, "x"), ("3", None, 1.0, "x"), ("3", "c", 7.0, "x")])
    got = {r.product_id: r.price for r in clean.clean_products(df).collect()}
    assert got == {"2": 5.0, "3": 7.0}
    same = clean.clean_products(normalize_primary(df))
    assert {r.product_id: r.price for r in same.collect()} == got


def test_audit_counts_every_step(spark):
    df = raw(spark, [("1", "a", 0.0, "x"), ("1", "a", 5.0, "x"), ("2", "b", 5.0, "x"), ("3", None, 1.0, "x")])
    got = {r.step: (r.rows_in, r.rows_out) for r in clean.cleaning_audit(normalize_primary(df)).collect()}
    assert got == {
        "drop_incomplete": (4, 3),
        "dedup_products": (3, 2),
        "positive_price": (2, 1),
        "flag_outliers": (1, 0),
    }
    empty = clean.cleaning_audit(normalize_primary(df.limit(0))).collect()
    assert [(r.rows_in, r.rows_out, r.pct_out) for r in empty] == [(0, 0, None)] * 4


def test_clip_and_defaults(products):
    df = products([{"rating": 5.5, "discount_ratio": 1.5}, {"rating": -0.5, "discount_ratio": -1.0}])
    got = [(r.rating, r.discount_ratio) for r in clean.clip_ranges(df).orderBy("product_id").collect()]
    assert got == [(5.0, 1.0), (0.0, 0.0)]
    holes = products([{}]).withColumns({n: F.lit(None).cast(t) for n, t in [("shop", "string"), ("list_price", "double"), ("units_sold", "bigint")]})
    row = clean.fill_defaults(holes).first()
    assert (row.shop, row.list_price, row.units_sold) == ("Tiki", 100.0, 0)


@pytest.mark.parametrize("prices", [[5.0], [5.0, 6.0], [10.0] * 6, list(range(1, 40)) + [1000.0, 0.5]])
def test_outlier_rule_against_numpy(products, prices):
    prices = [float(p) for p in prices]
    q1, q3 = np.quantile(prices, [0.25, 0.75])
    std = np.std(prices, ddof=1) if len(prices) > 1 else np.nan
    with np.errstate(invalid="ignore"):
        z = np.abs((np.array(prices) - np.mean(prices)) / (std + 1e-10)) > 3
    fence = (np.array(prices) < q1 - 1.5 * (q3 - q1)) | (np.array(prices) > q3 + 1.5 * (q3 - q1))
    got = clean.flag_price_outliers(products([{"price": p} for p in prices]))
    flags = {int(r.product_id): r.price_outlier for r in got.collect()}
    assert [flags[i] for i in range(len(prices))] == list(fence | z)


def test_cleaning_again_changes_nothing(spark):
    rng = np.random.default_rng(5)
    df = raw(spark, [(str(rng.integers(60)), "n", float(rng.integers(0, 50)), "s") for _ in range(200)])
    once = clean.clean_products(df)
    twice = clean.clean_products(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_empty_table(products):
    assert clean.flag_price_outliers(products([{}]).limit(0)).count() == 0


def test_later_copies_are_left_out_below_joins(spark):
    """A narrow hash aggregate finds the first copies, so that only they are widened and sorted."""
    line = spark.createDataFrame([("1", i, 7) for i in range(5, 0, -1)] + [("2", 3, 7)], "id string, n int, seller int")
    wide = line.join(spark.createDataFrame([(7, "s")], "key int, name string").hint("merge"), F.col("seller") == F.col("key"))
    df = wide.select("id", F.concat("name", F.col("n").cast("string")).alias("name"), F.struct("n").alias("arrival"))
    kept = clean.keep_first(df, "id")
    assert sorted((r.id, r.name) for r in kept.collect()) == [("1", "s1"), ("2", "s3")]
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("LeftSemi")


@pytest.mark.parametrize(
    "schema, rows, first",
    [
        ("arrival int", [(None,), (5,), (2,), (2,)], 2),
        ("arrival int", [(None,), (None,)], 0),
        ("arrival double", [(float("nan"),), (3.0,), (float("inf"),)], 1),
        ("arrival struct<a: int, b: int>", [(None,), ((1, 1),), ((None, 2),), ((None, 1),)], 3),
        ("arrival struct<a: int, b: string>", [((2, "a"),), ((1, "c"),), ((1, "b"),)], 2),
        ("arrival string", [("b",), ("a",)], 1),
        ("source_rank int, arrival_0 int, arrival_1 string", [(1, None, "a"), (0, 7, None), (0, 6, None)], 2),
        ("source_rank int, arrival_0 int, arrival_1 int", [(0, None, 1), (0, 5, 9), (0, 6, 0)], 1),
        ("source_rank int, arrival_1 int", [(1, 3), (1, 2), (0, None)], 2),
    ],
)
def test_first_copy_by_any_arrival(spark, schema, rows, first):
    """The narrow pass never leaves out the copy that the whole order puts first, null keys included."""
    df = spark.createDataFrame(
        [(key, i, *row) for key in ("x", None) for i, row in enumerate(rows)], f"id string, place int, {schema}"
    )
    names = clean._arrival_order(df)
    order = [F.col(n).asc_nulls_last() for n in names]
    plain = best_per_key(df, ["id"], order, 1)
    kept = clean.keep_first(df, "id")

    def shown(found):
        return sorted((str(r.id), str([r[n] for n in names])) for r in found.collect())

    assert shown(kept) == shown(plain)
    assert {r.place for r in kept.collect()} <= {i for i, row in enumerate(rows) if str(row) == str(rows[first])}


def test_missing_values_are_dropped_like_dropna(products):
    df = products([{}, {"price": float("nan")}, {"price": None}, {"product_name": None}, {"product_id": None}])
    assert [tuple(r) for r in clean.drop_incomplete(df).collect()] == [tuple(r) for r in df.dropna("any", subset=clean.REQUIRED).collect()]
