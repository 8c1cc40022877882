"""Readers of the two raw sources and the check run before using them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.sources import csv_records
from shopmetrics.schema import ARRIVAL, LISTING_FIELDS, listing_page_schema

REQUIRED_RAW_FIELDS = ["id", "name", "price"]


def read_listing_pages(
    spark: SparkSession,
    path: str,
    one_per_line: bool = False,
    fields: list[str] | None = None,
) -> DataFrame:
    """One row per product of landed page responses, in arrival order.

    Each file holds the response of one page, or with ``one_per_line`` one
    response per line (such files can be split). ``category=<id>/page=<n>``
    folders, when used, give the order of pages; otherwise file and line do.
    ``fields`` names what the source sends: a field that is named counts as a
    present column, even when a row lacks it.
    """
    pages = (
        spark.read.schema(listing_page_schema(fields or LISTING_FIELDS))
        .option("multiLine", not one_per_line)
        .json(path)
        .withColumns(
            {
                "_file": F.col("_metadata.file_path"),
                "_block": F.col("_metadata.file_block_start"),
                "_line": F.monotonically_increasing_id(),
            }
        )
    )
    page = F.regexp_extract("_file", r"page=([0-9]+)", 1).try_cast("bigint")
    folder = F.regexp_replace("_file", r"page=[0-9]+.*$", "")
    return (
        pages.select(
            folder.alias("_folder"),
            page.alias("_page"),
            "_file",
            "_block",
            "_line",
            F.posexplode("data").alias("_position", "_item"),
        )
        .select(
            "_item.*",
            F.struct(
                "_folder", "_page", "_file", "_block", "_line", "_position"
            ).alias(ARRIVAL),
        )
    )


def read_text_csv(
    spark: SparkSession, path: str, multiline: bool = True
) -> DataFrame:
    """CSV with a header; every column is text, plus the arrival order.

    Quoted values may span lines; large files are read by several tasks all the
    same (``csv_records``). ``multiline=False`` saves the scan that counts quotes
    where no value holds a line break.
    """
    if multiline:
        return csv_records.read_records(spark, path, ARRIVAL)
    reader = spark.read.option("header", True)
    for name, value in csv_records.OPTIONS.items():
        reader = reader.option(name, value)
    return reader.csv(path).withColumn(
        ARRIVAL,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


def read_raw_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Raw listing rows saved earlier (the fallback of the listing source)."""
    return read_text_csv(spark, path, multiline)


def read_marketplace_csv(
    spark: SparkSession, path: str, multiline: bool = True
) -> DataFrame:
    """Rows of the second source."""
    return read_text_csv(spark, path, multiline)


def check_source_contract(
    df: DataFrame, required: list[str] | None = None
) -> DataFrame:
    """One row: row count, rows lacking each required field, missing columns, ok."""
    required = required or REQUIRED_RAW_FIELDS
    present = [name for name in required if name in df.columns]
    absent = [name for name in required if name not in df.columns]
    nulls = [
        F.count_if(F.col(name).isNull()).alias(f"null_{name}") for name in present
    ] + [F.lit(None).cast("bigint").alias(f"null_{name}") for name in absent]
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *nulls)
    return counted.withColumn("missing", F.lit(",".join(absent))).withColumn(
        "ok", (F.col("n_rows") > 0) & F.lit(not absent)
    )
