"""Column expressions that turn loosely typed listing fields into values.

All of them are built from Spark SQL functions, so they stay inside code
generation, and none raises under ANSI mode: what cannot be parsed takes the
stated default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics import fixed_values as V

_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBER = (
    rf"[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
)
_INFINITY = r"[+-]?(?:[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)"
_NUMBER_TEXT = rf"(?U)^\s*({_NUMBER}|{_INFINITY})\s*$"
# Most numbers look like this; the pattern above takes them as they are, but is slow.
_PLAIN_NUMBER = r"^[0-9]+(?:\.[0-9]+)?\z"


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _number_text(text: Column) -> Column:
    """Parse a number literal; anything else (``12d``, hex, words) is null."""
    literal = F.translate(F.regexp_extract(text, _NUMBER_TEXT, 1), "_", "")
    return F.when(text.rlike(_PLAIN_NUMBER), text).otherwise(literal).try_cast("double")


def _finite_or(value: Column, default: Column) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), default)


def numeric_or(df: DataFrame, name: str, default: Column | float) -> Column:
    """Number in ``name``, or ``default`` for null, NaN and unparsable text.

    Currency signs and thousands separators are not removed here.
    """
    default = default if isinstance(default, Column) else F.lit(float(default))
    if isinstance(column_type(df, name), T.StringType):
        return _finite_or(_number_text(F.col(name)), default)
    return _finite_or(F.col(name).cast("double"), default)


def safe_double(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """Like ``numeric_or`` but first drops ``đ`` and ``,`` from texts."""
    fallback = F.lit(float(default))
    if isinstance(column_type(df, name), T.StringType):
        return _finite_or(_number_text(F.translate(F.col(name), "đ,", "")), fallback)
    return _finite_or(F.col(name).cast("double"), fallback)


def _whole_or_zero(*values: Column) -> Column:
    """Whole part of the first value that has one; NaN and infinity have none.

    Every value is referred to once, so that it is also computed once.
    """
    return F.coalesce(*[v.try_cast("bigint") for v in values], F.lit(0).cast("bigint"))


def units_sold(df: DataFrame, name: str, value_key: str = "value") -> Column:
    """Quantity sold from an object, a number or a text.

    An object gives its whole ``value`` (0 if absent), a number its whole part
    but at least 0, any other text its first run of digits.
    """
    dtype = column_type(df, name)
    source = F.col(name)
    zero = F.lit(0).cast("bigint")
    if isinstance(dtype, T.StructType):
        if value_key not in dtype.fieldNames():
            return zero
        return _whole_or_zero(source[value_key].try_cast("double"))
    if isinstance(dtype, T.StringType):
        inner = F.get_json_object(source, f"$.{value_key}")
        digits = F.regexp_extract(source, r"[0-9]+", 0)
        return F.when(
            F.ltrim(source).startswith("{"), _whole_or_zero(_number_text(inner))
        ).otherwise(F.greatest(_whole_or_zero(_number_text(source), digits), zero))
    return F.greatest(_whole_or_zero(source.cast("double")), zero)


def _map_literal(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def map_category(path: Column) -> Column:
    """Category name of an ``id/id/id`` path.

    The first id that is a family wins; failing that the last id of the
    detailed map; failing that the last id itself, prefixed.
    """
    text = F.concat(F.lit("/"), path.cast("string"), F.lit("/"))
    families, details = V.PARENT_CATEGORIES, V.DETAIL_CATEGORIES
    first_family = F.regexp_extract(text, f"/({'|'.join(families)})/", 1)
    last_detail = F.regexp_extract(text, f"(?s)^.*/({'|'.join(details)})/", 1)
    name = F.coalesce(
        F.try_element_at(_map_literal(families), first_family),
        F.try_element_at(_map_literal(details), last_detail),
        F.concat(
            F.lit(V.CATEGORY_PREFIX), F.substring_index(path.cast("string"), "/", -1)
        ),
    )
    empty = path.isNull() | (path.cast("string") == "")
    return F.when(empty, F.lit(V.UNKNOWN_CATEGORY)).otherwise(name)


def shop_name(df: DataFrame, name: str, default: str) -> Column:
    """Seller name; objects give their ``name``, blanks give ``default``."""
    dtype = column_type(df, name)
    if isinstance(dtype, T.StructType):
        text = (
            F.col(name)["name"].cast("string")
            if "name" in dtype.fieldNames()
            else F.lit(None).cast("string")
        )
    else:
        raw = F.col(name).cast("string")
        text = F.when(
            F.ltrim(raw).startswith("{"),
            F.coalesce(F.get_json_object(raw, "$.name"), raw),
        ).otherwise(raw)
    blank = text.isNull() | text.isin("", "nan") | (F.lower(text) == "none")
    return F.when(blank, F.lit(default)).otherwise(text)


def stripped(df: DataFrame, name: str) -> Column:
    """Text without surrounding whitespace; null and blank become null."""
    text = F.regexp_replace(F.col(name).cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(text != "", text)
