from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from shopmetrics.functions import parsing as P
from shopmetrics.functions.mathx import erfc


def column(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {dtype}")


def results(df, expression):
    return [row[0] for row in df.select(expression).collect()]


def test_safe_double_texts(spark):
    cases = {
        " 1,234đ": 1234.0,
        "12 đ": 12.0,
        "abc": 0.0,
        None: 0.0,
        "nan": 0.0,
        "1e3": 1000.0,
        "12d": 0.0,
        "0x10": 0.0,
        "1.200.000": 0.0,
        "-5": -5.0,
        "+.5": 0.5,
        "5.": 5.0,
        "1_000": 1000.0,
        "inf": math.inf,
        "-Infinity": -math.inf,
        "": 0.0,
        "\t7 ": 7.0,
    }
    df = column(spark, list(cases))
    assert results(df, P.safe_double(df, "c")) == list(cases.values())


def test_safe_double_numbers_and_default(spark):
    df = column(spark, [1.5, None, math.nan], "double")
    assert results(df, P.safe_double(df, "c", 9.0)) == [1.5, 9.0, 9.0]


def test_numeric_or_keeps_separators_out(spark):
    df = column(spark, ["199000", "199,000", "12đ", None])
    assert results(df, P.numeric_or(df, "c", 0.0)) == [199000.0, 0.0, 0.0, 0.0]


def test_units_sold_texts(spark):
    cases = {
        '{"text":"Đã bán 12","value":12}': 12,
        '{"text":"x"}': 0,
        '{"value":-4}': -4,
        '{"value":5.9}': 5,
        "{'text': 'Đã bán 7', 'value': 7}": 7,
        "5.7": 5,
        "-3": 0,
        "Đã bán 1.2k": 1,
        "sold -8": 8,
        "none": 0,
        "inf": 0,
        None: 0,
    }
    df = column(spark, list(cases))
    assert results(df, P.units_sold(df, "c")) == list(cases.values())


def test_units_sold_numbers(spark):
    df = column(spark, [5.7, -3.0, math.nan, math.inf, None], "double")
    assert results(df, P.units_sold(df, "c")) == [5, 0, 0, 0, 0]


def test_units_sold_struct(spark):
    df = spark.createDataFrame(
        [((3,),), ((None,),), ((-2,),)], "c struct<value:int>"
    )
    assert results(df, P.units_sold(df, "c")) == [3, 0, -2]


@pytest.mark.parametrize(
    "path, name",
    [
        ("1/915/8322", "Thời trang nam"),
        ("1/3/9", "Laptop"),
        ("1/2/77", "Tablet"),
        ("1/77", "Điện thoại (Cũ)"),
        ("0/77", "Ngành 77"),
        ("0/", "Ngành "),
        ("", "Chưa phân loại"),
        (None, "Chưa phân loại"),
    ],
)
def test_map_category(spark, path, name):
    df = column(spark, [path])
    assert results(df, P.map_category(F.col("c"))) == [name]


def test_shop_name(spark):
    cases = {
        None: "Tiki",
        "": "Tiki",
        "nan": "Tiki",
        "NaN": "NaN",
        "None": "Tiki",
        "NONE": "Tiki",
        '{"id":1,"name":"Shop X"}': "Shop X",
        "Plain": "Plain",
    }
    df = column(spark, list(cases))
    assert results(df, P.shop_name(df, "c", "Tiki")) == list(cases.values())


def test_erfc(spark):
    values = [-3.0, -0.5, 0.0, 0.3, 1.0, 2.5, 6.0]
    df = column(spark, values, "double")
    for x, got in zip(values, results(df, erfc(F.col("c")))):
        assert got == pytest.approx(math.erfc(x), rel=2e-7)


def test_plain_numbers_are_read_as_by_the_full_pattern(spark):
    """Digits with a point skip the slow pattern; whatever else looks alike doesn't."""
    texts = ["0", "007", "12.50", "1" * 400, "0.1", "12\n", "12\u0085", " 1", "1.", ".5", ".", "1.2.3",
             "１２", "٣", "12f", "1 2", "-0", "1e5", "1_0", "_1", "", " ", None, "NaN", "12\r\n", "1\n2"]
    df = column(spark, texts)
    full = F.translate(F.regexp_extract("c", P._NUMBER_TEXT, 1), "_", "").try_cast("double")
    assert results(df, P._number_text(F.col("c"))) == results(df, full)
    plan = df.select(P._number_text(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("regexp_extract")
