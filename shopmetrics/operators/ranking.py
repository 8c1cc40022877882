"""Exact ranks and quantiles without sorting a group in one task.

Rows are first collapsed to distinct values with counts, so a value shared by
many rows is one row. Distinct values then fall into buckets: the leading bits of
the value (sign, power of two and a thousandth of it), whatever its size, so that
a ratio near 0 is told apart as finely as a price in millions. Bucket totals are
summed in order (a small window). A bucket that holds more than ``FULL`` distinct
values is split once more by the next 20 bits, and the totals of its parts are
summed in order within it; other buckets aren't touched again. Only the values of
one bucket or part are sorted together: at most ``FULL``, or what doubles differ in
their last 22 bits. Buckets and parts are fixed non-decreasing functions of the value, so nothing
depends on how Spark happened to partition the rows and lost tasks can be recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Distinct values that a bucket may hold without being split.
FULL = 1 << 18
# Steps per power of two of a bucket, and of a part of a full bucket.
BUCKET_STEPS, PART_STEPS = 1 << 10, 1 << 30
# Between the buckets of one power of two and the next; more than two times the steps.
_APART = 1 << 12
_POWERS = 1100

_BUCKET, _PART = "_bucket", "_part"


def _power(value: Column) -> Column:
    """Power of two at or below the size of a finite value other than 0 (or next to it)."""
    return F.greatest(F.floor(F.log2(F.abs(value))), F.lit(-1022).cast("bigint"))


def _steps(value: Column, steps: int) -> Column:
    """How many steps of its power of two a value has, rounded down."""
    scaled = F.abs(value) * F.pow(F.lit(2.0), -_power(value))
    return F.floor(scaled * F.lit(float(steps)))


def _signed(value: Column, size: Column) -> Column:
    return F.when(value < 0, -size).otherwise(size)


def value_bucket(value: Column) -> Column:
    """Bucket number; never smaller for a larger value."""
    value = value.cast("double")
    size = (_power(value) + _POWERS) * _APART + _steps(value, BUCKET_STEPS)
    beyond = 4 * _POWERS * _APART
    return (
        F.when(F.isnan(value), F.lit(2 * beyond))
        .when(F.abs(value) == float("inf"), _signed(value, F.lit(beyond)))
        .when(value == 0, F.lit(0))
        .otherwise(_signed(value, size))
        .cast("bigint")
    )


def value_part(value: Column) -> Column:
    """Number of a value's part within its bucket; never smaller for a larger value."""
    value = value.cast("double")
    plain = ~F.isnan(value) & (F.abs(value) != float("inf")) & (value != 0)
    return F.when(plain, _signed(value, _steps(value, PART_STEPS))).otherwise(0).cast("bigint")


def distinct_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct non-null values per group with their row count ``n``."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _totals(values: DataFrame, by: list[str], key: str, weight: str) -> DataFrame:
    """Per group and key: rows, weight, and the weight of the group's smaller keys."""
    earlier = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        values.groupBy(*by, key)
        .agg(F.sum(weight).alias(f"_in{key}"), F.count(F.lit(1)).alias(f"_rows{key}"))
        .withColumn(f"_before{key}", F.coalesce(F.sum(f"_in{key}").over(earlier), F.lit(0)))
    )


def _join_keys(values: DataFrame, keys: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    left, right = values.alias("v"), keys.alias("b")
    same = F.lit(True)
    for name in by:
        same = same & F.col(f"v.{name}").eqNullSafe(F.col(f"b.{name}"))
    carried = [c for c in keys.columns if c not in by]
    return left.join(right, same, how).select("v.*", *[f"b.{c}" for c in carried])


def _placed(
    values: DataFrame, value: str, by: list[str], weight: str, wanted=None
) -> DataFrame:
    """Values with ``before``, the weight of smaller ones, and the group's ``total``.

    ``wanted`` (a function of first place, size and total) drops buckets and parts
    that hold no wanted place before their values are sorted.
    """
    whole = Window.partitionBy(*by)
    bucketed = values.withColumn(_BUCKET, value_bucket(F.col(value)))
    buckets = _totals(bucketed, by, _BUCKET, weight).withColumn(
        "total", F.sum(f"_in{_BUCKET}").over(whole)
    )
    if wanted is not None:
        buckets = buckets.where(wanted(F.col(f"_before{_BUCKET}"), F.col(f"_in{_BUCKET}")))
    full = F.col(f"_rows{_BUCKET}") > FULL
    part = value_part(F.col(value))
    # The parts of full buckets; without full buckets an empty side that costs nothing.
    split = _join_keys(bucketed, buckets.where(full).select(*by, _BUCKET), [*by, _BUCKET])
    parts = _totals(split.withColumn(_PART, part), [*by, _BUCKET], _PART, weight)
    joined = _join_keys(bucketed, buckets, [*by, _BUCKET]).withColumn(
        _PART, F.when(full, part).otherwise(F.lit(0).cast("bigint"))
    )
    joined = _join_keys(joined, parts, [*by, _BUCKET, _PART], "left")
    start = F.col(f"_before{_BUCKET}") + F.coalesce(F.col(f"_before{_PART}"), F.lit(0))
    if wanted is not None:
        size = F.coalesce(F.col(f"_in{_PART}"), F.col(f"_in{_BUCKET}"))
        joined = joined.where(wanted(start, size))
    smaller = (
        Window.partitionBy(*by, _BUCKET, _PART)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return joined.withColumn(
        "before", start + F.coalesce(F.sum(weight).over(smaller), F.lit(0))
    ).select(*values.columns, "before", "total")


def with_prefix(
    values: DataFrame, value: str, by: list[str] | None = None, weight: str = "n"
) -> DataFrame:
    """Add ``before`` and ``total`` to a table of distinct values per group.

    ``before`` is the summed weight of the group's strictly smaller values,
    ``total`` the summed weight of the group. ``values`` must hold each value
    once per group. Further columns are kept.
    """
    return _placed(values, value, by or [], weight)


def average_rank() -> Column:
    """1-based rank of a value, ties sharing the mean of their places."""
    return F.col("before") + (F.col("n") + 1) / 2


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: list[str] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group.

    ``probabilities`` maps output column names to probabilities. Only buckets
    that hold a wanted position are sorted.
    """
    by = by or []

    def place(p: float) -> Column:
        return (F.col("total") - 1) * F.lit(float(p))

    def holds(start: Column, size: Column, position: Column) -> Column:
        return (start <= position) & (position < start + size)

    ends = [
        end(place(p)) for p in set(probabilities.values()) for end in (F.floor, F.ceil)
    ]

    def wanted(start: Column, size: Column) -> Column:
        some = F.lit(False)
        for position in ends:
            some = some | holds(start, size, position)
        return some

    found = _placed(distinct_counts(df, value, by), value, by, "n", wanted)
    picks = []
    for i, p in enumerate(probabilities.values()):
        for side, end in (("lo", F.floor), ("hi", F.ceil)):
            hit = holds(F.col("before"), F.col("n"), end(place(p)))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}{i}"))
    picked = found.groupBy(*by).agg(F.max("total").alias("total"), *picks)
    interpolated = []
    for i, (name, p) in enumerate(probabilities.items()):
        share = place(p) - F.floor(place(p))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        mixed = F.when(high == low, low).otherwise(low + (high - low) * share)
        interpolated.append(mixed.cast("double").alias(name))
    return picked.select(*by, *interpolated)
