"""Raw listings of both sources as views over a star schema.

``raw_listings`` turns every line item into one listing of the primary source
(so products repeat, names are missing and prices are zero here and there);
``marketplace_rows`` turns parts into text rows of the second source;
``product_pages`` gives stored pages preview tags and product urls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics import fixed_values as V
from shopmetrics.schema import ARRIVAL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw listing per line item.

    The id is made from the line item alone: Spark pushes a semi join on it (the first
    copies of products, for one) below the joins that add texts.
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_shipdate",
        F.col("l_partkey").cast("string").alias("id"),
    )
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    family = (
        F.when(F.col("p_type") == "PROMO", "8322")
        .when(F.col("p_type") == "LARGE", "1789")
        .when(F.col("p_type") == "SMALL", "915")
        .otherwise("x")
    )
    order = F.col("l_orderkey")
    null_text = F.lit(None).cast("string")
    null_double = F.lit(None).cast("double")
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "id",
            F.when(order % 101 == 0, null_text)
            .otherwise(F.concat_ws(" ", "p_name", "p_brand"))
            .alias("name"),
            F.when(order % 97 == 0, F.lit(0.0))
            .otherwise(
                # Half up to cents by plain arithmetic: engines differ in how
                # their round() treats binary ties.
                F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
            )
            .alias("price"),
            F.when(order % 7 == 0, null_double)
            .otherwise(F.col("p_retailprice") * 10)
            .alias("original_price"),
            F.when(order % 5 == 0, null_double)
            .otherwise(F.round(F.col("l_discount") * 100, 0))
            .alias("discount_rate"),
            F.format_string(
                '{"text":"x","value":%d}', F.col("l_quantity").cast("bigint")
            ).alias("quantity_sold"),
            ((F.col("p_partkey") % 12) * F.lit(0.5)).alias("rating_average"),
            F.concat_ws("/", F.lit("99"), family, F.col("p_size")).alias(
                "primary_category_path"
            ),
            F.col("s_name").alias("seller"),
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("url_path"),
            F.struct(
                "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"
            ).alias(ARRIVAL),
        )
    )


def marketplace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of the second source, one per part, with the usual defects."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    null_text = F.lit(None).cast("string")
    amount = F.col("p_retailprice")
    return part.select(
        F.concat(F.lit("k"), key.cast("string")).alias("product_id"),
        F.when(key % 29 == 0, F.lit("  "))
        .when(key % 31 == 0, null_text)
        .otherwise(F.concat(F.lit(" "), "p_name"))
        .alias("title"),
        F.when(key % 11 == 0, F.concat(F.lit("1,"), amount.cast("string"), F.lit(" đ")))
        .when(key % 13 == 0, F.lit("abc"))
        .when(key % 17 == 0, F.lit("12d"))
        .when(key % 19 == 0, F.lit("1e3"))
        .otherwise(amount.cast("string"))
        .alias("price"),
        F.when(key % 3 == 0, null_text)
        .when(key % 5 == 0, F.lit("0"))
        .otherwise((amount + key % 7 * 100 - 200).cast("string"))
        .alias("original_price"),
        F.when(key % 4 == 0, F.lit("None"))
        .when(key % 6 == 0, F.lit("nan"))
        .otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" ")))
        .alias("seller"),
        ((key % 12) * F.lit(0.5)).cast("string").alias("rating_average"),
        F.when(key % 8 == 0, null_text)
        .otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".7")))
        .alias("reviews"),
        F.when(key % 9 == 0, null_text).otherwise(F.col("p_type")).alias("category"),
        F.when(
            key % 2 == 0, F.concat(F.lit("https://shop.example/"), key.cast("string"))
        ).alias("url"),
        F.when(key % 3 != 0, F.concat(F.lit("s-"), key.cast("string"))).alias("slug"),
    )


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages with preview tags in several spellings and product urls."""
    pages = table(spark, sf_dir, "pages")
    key = F.col("page_id")
    image = F.concat(F.lit("https://img.example/"), key.cast("string"), F.lit(".png"))
    head = (
        F.when(
            key % 5 == 1,
            F.concat(
                F.lit('<meta property="og:image" content="'), image, F.lit('">'),
                F.lit('<meta property="og:title" content="Title &amp; '),
                key.cast("string"), F.lit('">'),
                F.lit('<meta property="og:description" content="About">'),
            ),
        )
        .when(
            key % 5 == 2,
            F.concat(
                F.lit("<META content='"), image, F.lit("' property='og:image' />"),
            ),
        )
        .when(
            key % 5 == 3,
            F.lit('<meta property="og:image"><meta property="og:title" content="t">'),
        )
        .when(
            key % 5 == 4,
            F.lit('<!-- <meta property="og:title" content="hidden"> -->'),
        )
        .otherwise(F.lit(""))
    )
    return pages.select(
        "page_id",
        F.concat(F.lit(V.PRIMARY_URL_PREFIX + "p"), key.cast("string")).alias("url"),
        F.concat(head, "html").alias("html"),
    )
