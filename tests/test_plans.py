"""Plans stay inside Spark, distributed, and read only what they need."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL_DATA

from shopmetrics.plans import catalog, star_view
from shopmetrics.operators import assistant, clean

# Fitting and writing queries run jobs of their own while they are built.
EAGER = ("m4_", "m6_", "s")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if not n.startswith(EAGER)])
def test_no_python_rows_and_no_cross_join(spark, name):
    text = plan(catalog.QUERIES[name](spark, SMALL_DATA))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct",
                     "BroadcastNestedLoopJoin", "InMemoryRelation"):
        assert operator not in text, operator


def test_top_k_is_cut_before_the_shuffle(spark):
    raw = star_view.raw_listings(spark, SMALL_DATA)
    assert "WindowGroupLimit" in plan(clean.clean_products(raw))
    table = catalog.advised(spark, SMALL_DATA)
    requests = catalog.budget_requests(spark, SMALL_DATA)
    assert "WindowGroupLimit" in plan(assistant.cheaper_alternatives(table))
    assert "WindowGroupLimit" in plan(assistant.recommend_batch(table, requests))
    one = assistant.recommend_under_budget(table, 2000.0)
    assert "TakeOrderedAndProject" in plan(one)
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(price,2000.0\)", plan(one))


def test_scans_read_few_columns(spark):
    table = catalog.products(spark, SMALL_DATA)
    text = plan(table.groupBy("category").count())
    assert "ReadSchema: struct<category:string>" in text
    raw = star_view.raw_listings(spark, SMALL_DATA)
    text = plan(clean.clean_unflagged(raw).select("price"))
    assert "s_name" not in text and "l_discount" not in text


def test_windows_over_products_are_partitioned(spark):
    table = catalog.products(spark, SMALL_DATA)
    for name in ("a6_spearman", "a9_mann_whitney", "r1_price_percentile", "c7_flag_price_outliers"):
        text = plan(catalog.QUERIES[name](spark, SMALL_DATA))
        for window in re.findall(r"Window \[.*", text):
            if "_in_bucket" not in window and "_before_bucket" not in window:
                assert "_bucket" in window, window
    assert table.count() > 0
