from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators.normalize import (
    normalize_marketplace,
    normalize_primary,
    union_sources,
)
from shopmetrics.schema import PRODUCT_COLUMNS


def by_id(df):
    return {row["product_id"]: row for row in df.collect()}


def test_primary_columns_present(spark):
    df = spark.createDataFrame(
        [
            ("1", "Áo", "199000", "250000", "20", '{"value":3}', "4.5", "1/915", None, "a", "p1"),
            ("2", None, "199,000", None, None, None, None, None, "nan", "b", None),
            (None, "x", "0", "10", "150", "7", "5.4", "0/77", "Shop", "c", "p3"),
        ],
        "id string, name string, price string, original_price string, discount_rate string,"
        "quantity_sold string, rating_average string, primary_category_path string,"
        "current_seller string, seller string, url_path string",
    )
    got = by_id(normalize_primary(df))
    assert list(normalize_primary(df).columns) == PRODUCT_COLUMNS
    one = got["1"]
    assert (one.price, one.list_price, one.discount_ratio) == (199000.0, 250000.0, 0.2)
    assert (one.units_sold, one.rating, one.category) == (3, 4.5, "Thời trang nam")
    # A present seller column hides the alternative one, even when it is null.
    assert (one.shop, one.platform, one.url) == ("Tiki", "Tiki", "https://tiki.vn/p1")
    two = got["2"]
    assert (two.price, two.list_price, two.discount_ratio) == (0.0, 0.0, 0.0)
    assert (two.product_name, two.shop, two.url) == (None, "Tiki", "")
    assert two.category == "Chưa phân loại"
    three = got[None]
    assert (three.discount_ratio, three.rating, three.shop) == (1.5, 5.4, "Shop")


def test_primary_columns_absent(spark):
    df = spark.createDataFrame(
        [("1", "a", 80.0, 100.0, "Sel"), ("2", "b", 120.0, 100.0, "")],
        "id string, name string, price double, list_price double, seller string",
    )
    got = by_id(normalize_primary(df))
    assert got["1"].discount_ratio == pytest.approx(0.2)
    assert got["2"].discount_ratio == 0.0
    assert (got["1"].shop, got["2"].shop) == ("Sel", "Tiki")
    assert (got["1"].rating, got["1"].units_sold, got["1"].url) == (0.0, 0, "")
    bare = spark.createDataFrame([("1", "a")], "id string, name string")
    assert by_id(normalize_primary(bare))["1"].price == 0.0


def test_primary_passes_product_tables_through(spark):
    df = spark.createDataFrame(
        [("1", "a", 5.0)], "product_id string, product_name string, price double"
    )
    assert normalize_primary(df).first().asDict() == {
        "product_id": "1", "product_name": "a", "price": 5.0, "price_outlier": False,
    }


def test_marketplace(spark):
    df = spark.createDataFrame(
        [
            (" 7 ", " Mũ ", "80", "100", "None", "4.5", "12.9", " Mũ nón ", None, "mu"),
            ("8", "x", "120", "100", " S ", "bad", None, None, "http://u", "s"),
            ("9", "y", "50", "0", None, None, "3", "C", None, None),
            ("10", "  ", "1", "1", "S", "1", "1", "C", None, None),
            (None, "z", "1", "1", "S", "1", "1", "C", None, None),
        ],
        "product_id string, title string, price string, list_price string, shop string,"
        "rating_average string, quantity_sold string, nganh_hang string, url string, slug string",
    )
    got = by_id(normalize_marketplace(df))
    assert set(got) == {"7", "8", "9"}
    seven = got["7"]
    assert (seven.product_name, seven.category, seven.shop) == ("Mũ", "Mũ nón", "Kaggle")
    assert (seven.units_sold, seven.rating) == (12, 4.5)
    assert seven.discount_ratio == pytest.approx(0.2)
    assert seven.url == "https://kaggle.com/product/mu"
    assert (got["8"].discount_ratio, got["8"].shop, got["8"].rating) == (0.0, "S", 0.0)
    assert (got["8"].url, got["8"].category) == ("http://u", "Chưa phân loại")
    assert (got["9"].list_price, got["9"].url) == (50.0, "")
    assert {row.platform for row in got.values()} == {"Kaggle"}


def test_marketplace_without_id_gives_every_row_its_own(spark):
    df = spark.createDataFrame(
        [("a", "1"), ("b", "1"), ("c", "2")], "name string, price string"
    )
    assert len(by_id(normalize_marketplace(df))) == 3


def test_union_defaults_and_order(spark, products):
    first = products([{"product_id": "1"}]).drop("price_outlier", "url")
    second = products([{"product_id": "2"}]).drop("price_outlier", "platform", "url", "rating")
    merged = union_sources(first, second)
    assert merged.columns == [*PRODUCT_COLUMNS, "source_rank"]
    got = by_id(merged)
    assert (got["1"].url, got["2"].url) == ("", "")
    assert (got["1"].platform, got["2"].platform) == ("P", None)
    assert got["2"].rating is None
    with pytest.raises(ValueError):
        union_sources()


def test_union_prefers_earlier_source_and_arrival(spark, products):
    from shopmetrics.operators.clean import dedup_products

    a = products([{"product_id": "1", "shop": "late"}, {"product_id": "1", "shop": "early"}])
    a = a.withColumn("arrival", F.when(F.col("shop") == "late", 9).otherwise(2))
    b = products([{"product_id": "1", "shop": "other"}, {"product_id": "2", "shop": "b"}])
    b = b.withColumn("arrival", F.struct(F.lit("file"), F.lit(0)))
    kept = by_id(dedup_products(union_sources(a, b)))
    assert (kept["1"].shop, kept["2"].shop) == ("early", "b")
    kept = by_id(dedup_products(union_sources(b, a)))
    assert kept["1"].shop == "other"
