"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect
from conftest import SMALL_DATA

import __spark_entry__ as entry
from shopmetrics.plans import catalog

WITHOUT_SQL = {"m4_k_table", "m6_segment_products"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL_DATA)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(entry.oracle_sql()) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SMALL_DATA) == ""


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5
    scores = [r.value_score for r in rows]
    assert scores == sorted(scores, reverse=True)
