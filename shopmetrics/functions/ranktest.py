"""Exact distribution of the rank sum statistic U of two small samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest table of counts; beyond it callers keep the approximation.
MOST_COUNTS = 200_000


def _count_table(n: Column, m: Column, upto: Column) -> Column:
    """In how many orders of n and m distinct values U is 0, 1, ... ``upto``.

    The counts have the generating function of the products (1 - q^(m+i)) / (1 - q^i)
    for i from 1 to n, and 1 / (1 - q^i) is the product of 1 + q^(i 2^j) for all j from 0.
    So the table is a fold: each factor adds to every count the one so many places
    before it, or takes it off (negative places).
    """

    def factors(i: Column) -> Column:
        doubled = F.sequence(F.lit(0), F.floor(F.log2(upto / i + 1)).cast("int"))
        added = F.transform(doubled, lambda j: i * F.pow(F.lit(2), j).cast("bigint"))
        return F.concat(added, F.array(-(m + i)))

    def multiply(counts: Column, places: Column) -> Column:
        return F.transform(
            counts,
            lambda count, u: count
            + F.signum(places) * F.coalesce(F.get(counts, (u - F.abs(places)).cast("int")), F.lit(0.0)),
        )

    start = F.transform(F.sequence(F.lit(0).cast("bigint"), upto), lambda u: F.when(u == 0, 1.0).otherwise(0.0))
    every = F.flatten(F.transform(F.sequence(F.lit(1).cast("bigint"), n), factors))
    return F.aggregate(every, start, multiply)


def exact_p(n_a: Column, n_b: Column, u: Column) -> Column:
    """Probability of a U at least as far from its mean as ``u``, without ties.

    Null where a group is empty or the table would be longer than ``MOST_COUNTS``.
    """
    n, m = F.least(n_a, n_b).cast("bigint"), F.greatest(n_a, n_b).cast("bigint")
    smaller = F.floor(F.least(u, n * m - u)).cast("bigint")
    orders = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), n), F.lit(1.0), lambda c, i: c * (m + i) / i
    )
    counted = F.aggregate(_count_table(n, m, smaller), F.lit(0.0), lambda total, c: total + c)
    fits = (n > 0) & (n * m <= MOST_COUNTS) & u.isNotNull()
    return F.when(fits, F.least(F.lit(1.0), 2 * counted / orders))
