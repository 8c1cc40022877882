"""Numeric column expressions Spark SQL has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients of the exponential-polynomial
# approximation of erfc (fractional error below 1.2e-7 everywhere).
ERFC_COEFFICIENTS = [
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
]


def erfc(x: Column) -> Column:
    """Complementary error function."""
    size = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + size * 0.5)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for coefficient in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(coefficient) + t * poly
    tail = t * F.exp(-size * size + poly)
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def whole_text(value: Column) -> Column:
    """A double shown without decimals, rounded half up."""
    return F.round(value, 0).cast("bigint").cast("string")


def tenth_text(value: Column) -> Column:
    """A double shown with one decimal, rounded half up."""
    return F.format_string("%.1f", F.round(value, 1))
