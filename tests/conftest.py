from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from shopmetrics.schema import CLEAN_SCHEMA  # noqa: E402

SMALL_DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("shopmetrics-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shopmetrics-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def products(spark):
    """Make a product table; what a row leaves out takes a plain value."""

    def make(rows: list[dict]):
        plain = {
            "product_name": "name",
            "price": 100.0,
            "list_price": 100.0,
            "discount_ratio": 0.0,
            "units_sold": 0,
            "rating": 4.0,
            "category": "A",
            "platform": "P",
            "shop": "S",
            "url": "u",
            "price_outlier": False,
        }
        filled = [{**plain, "product_id": str(i), **row} for i, row in enumerate(rows)]
        names = CLEAN_SCHEMA.fieldNames()
        return spark.createDataFrame(
            [tuple(r[n] for n in names) for r in filled], CLEAN_SCHEMA
        )

    return make
