"""From raw rows of either source to the product columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics import fixed_values as V
from shopmetrics.functions import parsing as P
from shopmetrics.schema import (
    ARRIVAL,
    OUTLIER_COLUMN,
    PRODUCT_COLUMNS,
    PRODUCT_SCHEMA,
    SOURCE_RANK,
    order_columns,
)


def _first_present(df: DataFrame, names: list[str]) -> str | None:
    return next((name for name in names if name in df.columns), None)


def price_columns(df: DataFrame) -> tuple[Column, Column]:
    """Price and list price of primary rows."""
    price_name = _first_present(df, ["price"])
    price = P.numeric_or(df, price_name, 0.0) if price_name else F.lit(0.0)
    list_name = _first_present(df, ["original_price", "list_price"])
    list_price = P.numeric_or(df, list_name, price) if list_name else price
    return price, list_price


def discount_ratio(df: DataFrame, price: Column, list_price: Column) -> Column:
    """Stated discount as a ratio, else the one the two prices imply."""
    if "discount_rate" in df.columns:
        return P.numeric_or(df, "discount_rate", 0.0) / 100
    implied = F.greatest(F.try_divide(list_price - price, list_price), F.lit(0.0))
    return F.when(list_price > 0, implied).otherwise(F.lit(0.0))


def product_url(df: DataFrame) -> Column:
    if "url_path" in df.columns:
        path = F.col("url_path").cast("string")
        return F.coalesce(F.concat(F.lit(V.PRIMARY_URL_PREFIX), path), F.lit(""))
    if "url" in df.columns:
        return F.coalesce(F.col("url").cast("string"), F.lit(""))
    return F.lit("")


def platform_name(df: DataFrame) -> Column:
    if "platform" in df.columns:
        return F.coalesce(F.col("platform").cast("string"), F.lit(V.UNKNOWN_PLATFORM))
    return F.lit(V.PRIMARY_PLATFORM)


def normalize_primary(df: DataFrame) -> DataFrame:
    """Raw listing rows as product columns (plus the arrival order, if any).

    Rows that already have the product columns pass through; they only gain
    the outlier flag when it is missing.
    """
    if {"product_id", "product_name", "price"} <= set(df.columns):
        if OUTLIER_COLUMN in df.columns:
            return df
        return df.withColumn(OUTLIER_COLUMN, F.lit(False))

    category_name = _first_present(df, ["primary_category_path", "category_id"])
    shop_column = _first_present(df, ["current_seller", "seller"])
    price, list_price = price_columns(df)
    columns = {
        "product_id": F.col("id").cast("string") if "id" in df.columns else F.lit(""),
        "product_name": F.col("name") if "name" in df.columns else F.lit(""),
        "price": price,
        "list_price": list_price,
        "discount_ratio": discount_ratio(df, price, list_price),
        "units_sold": P.units_sold(df, "quantity_sold")
        if "quantity_sold" in df.columns
        else F.lit(0),
        "rating": P.numeric_or(df, "rating_average", 0.0)
        if "rating_average" in df.columns
        else F.lit(0.0),
        "category": P.map_category(F.col(category_name))
        if category_name
        else F.lit(V.UNKNOWN_CATEGORY),
        "platform": platform_name(df),
        "shop": P.shop_name(df, shop_column, V.PRIMARY_PLATFORM)
        if shop_column
        else F.lit(V.PRIMARY_PLATFORM),
        "url": product_url(df),
    }
    return df.select(
        *[
            columns[field.name].cast(field.dataType).alias(field.name)
            for field in PRODUCT_SCHEMA.fields
        ],
        *order_columns(df),
    )


def normalize_marketplace(df: DataFrame) -> DataFrame:
    """Rows of the second source as product columns; blank id or name is skipped.

    Which of two alternative columns is read depends on which column the
    source has, not on single values.
    """
    names = {
        "id": _first_present(df, ["id", "product_id"]),
        "name": _first_present(df, ["name", "title"]),
        "list": _first_present(df, ["original_price", "list_price"]),
        "shop": _first_present(df, ["seller", "shop"]),
        "rating": _first_present(df, ["rating", "rating_average"]),
        "units": _first_present(df, ["reviews", "quantity_sold"]),
        "category": _first_present(df, ["category", "nganh_hang"]),
    }
    row_hash = F.xxhash64(*[F.col(name) for name in df.columns]).cast("string")
    price = P.safe_double(df, "price") if "price" in df.columns else F.lit(0.0)
    stated = P.safe_double(df, names["list"]) if names["list"] else price
    list_price = F.when(stated == 0, price).otherwise(stated)
    ratio = F.when(
        (list_price > 0) & (price <= list_price),
        F.lit(1.0) - F.try_divide(price, list_price),
    ).otherwise(F.lit(0.0))
    shop = P.stripped(df, names["shop"]) if names["shop"] else F.lit(None)
    no_shop = shop.isNull() | (shop == "nan") | (F.lower(shop) == "none")
    url = P.stripped(df, "url") if "url" in df.columns else F.lit(None)
    slug_url = (
        F.concat(F.lit(V.MARKETPLACE_URL_PREFIX), P.stripped(df, "slug"))
        if "slug" in df.columns
        else F.lit(None)
    )
    units = P.safe_double(df, names["units"]) if names["units"] else F.lit(0.0)
    category = P.stripped(df, names["category"]) if names["category"] else F.lit(None)
    columns = {
        "product_id": P.stripped(df, names["id"]) if names["id"] else row_hash,
        "product_name": P.stripped(df, names["name"]) if names["name"] else F.lit(None),
        "price": price,
        "list_price": list_price,
        "discount_ratio": ratio,
        "units_sold": units.try_cast("bigint"),
        "rating": P.safe_double(df, names["rating"]) if names["rating"] else F.lit(0.0),
        "category": F.coalesce(category, F.lit(V.UNKNOWN_CATEGORY)),
        "platform": F.lit(V.MARKETPLACE_PLATFORM),
        "shop": F.when(no_shop, F.lit(V.MARKETPLACE_PLATFORM)).otherwise(shop),
        "url": F.coalesce(url, slug_url, F.lit("")),
    }
    return df.select(
        *[
            columns[field.name].cast(field.dataType).alias(field.name)
            for field in PRODUCT_SCHEMA.fields
        ],
        *order_columns(df),
    ).filter(F.col("product_id").isNotNull() & F.col("product_name").isNotNull())


def _default_for(field: T.StructField) -> Column:
    if field.name == "platform":
        return F.lit(V.UNKNOWN_PLATFORM)
    return F.lit("" if isinstance(field.dataType, T.StringType) else 0)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources under one set of columns, in the given order of preference.

    A column no source has takes its default; one that only some sources have
    is null for the others. Rows keep their arrival order within a source.
    """
    if not sources:
        raise ValueError("no source to union")
    ranked = []
    for rank, df in enumerate(sources):
        kept = [name for name in PRODUCT_COLUMNS if name in df.columns]
        order = [F.col(ARRIVAL).alias(f"{ARRIVAL}_{rank}")] if ARRIVAL in df.columns else []
        ranked.append(df.select(*kept, *order, F.lit(rank).alias(SOURCE_RANK)))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    columns = [
        (
            F.col(field.name)
            if field.name in merged.columns
            else _default_for(field)
        )
        .cast(field.dataType)
        .alias(field.name)
        for field in PRODUCT_SCHEMA.fields
    ]
    return merged.select(*columns, *order_columns(merged))
