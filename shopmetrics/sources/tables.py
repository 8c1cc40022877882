"""Writers and readers of raw rows, product tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.operators.clean import outliers
from shopmetrics.operators.stats import quality_report
from shopmetrics.schema import CLEAN_SCHEMA, order_columns, require_columns
from shopmetrics.sources.snapshots import read_table, replace_table

# JSON lines are compressed; a file, which one task reads, has at most so many.
JSON_OPTIONS = {"compression": "gzip", "maxRecordsPerFile": 1_000_000}

_NESTED = (T.StructType, T.ArrayType, T.MapType)


def _without_arrival(df: DataFrame) -> DataFrame:
    return df.drop(*order_columns(df))


def _flat_for_csv(df: DataFrame) -> DataFrame:
    """CSV has no nested values; they become JSON text."""
    return df.select(
        [
            F.to_json(field.name).alias(field.name)
            if isinstance(field.dataType, _NESTED)
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )


def _write_csv(df: DataFrame, path: str) -> None:
    (
        _flat_for_csv(df)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_raw(df: DataFrame, csv_path: str, json_path: str | None = None) -> bool:
    """Write raw rows as CSV and, if asked, as JSON records; False when there are none."""
    if df.isEmpty():
        return False
    rows = _without_arrival(df)
    _write_csv(rows, csv_path)
    if json_path:
        write_json(rows, json_path)
    return True


def write_json(df: DataFrame, path: str) -> None:
    """Write rows as compressed JSON lines."""
    df.write.mode("overwrite").options(**JSON_OPTIONS).json(path)


def write_products(df: DataFrame, path: str, keep: int = 2) -> None:
    """Replace the product table; readers see the old one or the new one, never a part."""
    replace_table(_without_arrival(df), path, keep)


def read_products(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The product table (or a kept version of it); fails early if it lacks a product column."""
    df = read_table(spark, path, back)
    require_columns(df, CLEAN_SCHEMA.fieldNames())
    return df


def write_outliers(df: DataFrame, path: str) -> bool:
    """Write the flagged products as CSV, only if there are any."""
    flagged = outliers(df)
    if flagged.isEmpty():
        return False
    _write_csv(flagged, path)
    return True


def write_scored(df: DataFrame, path: str) -> None:
    """Write the scored and segmented table as CSV."""
    _write_csv(df, path)


def write_quality_report(df: DataFrame, path: str) -> None:
    """Write the quality report in long form, one row per figure."""
    _write_csv(quality_report(df), path)
