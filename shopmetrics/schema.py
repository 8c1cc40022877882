"""Column names and types of the product table."""

from __future__ import annotations

from pyspark.sql import types as T

PRODUCT_SCHEMA = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("list_price", T.DoubleType()),
        T.StructField("discount_ratio", T.DoubleType()),
        T.StructField("units_sold", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("shop", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)
PRODUCT_COLUMNS = PRODUCT_SCHEMA.fieldNames()
OUTLIER_COLUMN = "price_outlier"
CLEAN_SCHEMA = T.StructType(
    PRODUCT_SCHEMA.fields + [T.StructField(OUTLIER_COLUMN, T.BooleanType())]
)
CLEAN_COLUMNS = CLEAN_SCHEMA.fieldNames()

# Columns that say in which order rows arrived; they decide which copy of a
# product is kept and are dropped once duplicates are gone.
# ``arrival`` is any sortable value; after a union of sources there is one such
# column per source, ``arrival_<rank>``.
SOURCE_RANK = "source_rank"
ARRIVAL = "arrival"


def order_columns(df) -> list[str]:
    """Names of the arrival order columns ``df`` has, most significant first."""
    return [name for name in df.columns if name == SOURCE_RANK] + sorted(
        name for name in df.columns if name == ARRIVAL or name.startswith(f"{ARRIVAL}_")
    )

# Fields of a listing, all read as text because some hold several JSON types.
LISTING_FIELDS = [
    "id",
    "name",
    "price",
    "original_price",
    "discount_rate",
    "quantity_sold",
    "rating_average",
    "primary_category_path",
    "current_seller",
    "url_path",
]


def listing_page_schema(fields: list[str]) -> T.StructType:
    """Schema of one page response holding listings with these fields."""
    item = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    return T.StructType([T.StructField("data", T.ArrayType(item))])


FEATURES = ["price", "rating", "units_sold", "discount_ratio"]
SCALED_FEATURES = [f"{name}_scaled" for name in FEATURES]


def require_columns(df, columns: list[str], hint: str = "") -> None:
    """Raise ValueError naming the columns ``df`` lacks."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}. {hint}".strip())
