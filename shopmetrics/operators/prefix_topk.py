"""Best k rows among all rows that lie below given bounds, for many bounds at once.

A query asks, inside a group, for the k best candidates whose position is below
the query's bound on every axis ("cheaper than this", "rated at least that").
Joining queries to candidates would emit a pair for nearly every two rows of a
group. Instead each axis is cut into dyadic blocks: the positions 0..b-1 are the
disjoint union of one block per set bit of b. Candidates keep only the k best
per block, queries look up their few blocks, and the k best of those are the
exact answer. Rows grow by the product of the bit lengths, never by the size of
a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A block of 2^l positions on the first axis is asked for by queries at up to
# 2^l positions. Blocks above this level are kept in several copies, each
# serving 2^LEVEL_SERVED positions, so no join key collects a whole group.
LEVEL_SERVED = 14
# Bits of the bands that an axis is cut into before blocks are built.
BAND_BITS = 6


@dataclass(frozen=True)
class Axis:
    """Names of the position (candidates), bound (queries) and top position.

    ``top`` is the largest position in the group; both sides carry it, and it
    limits how many block sizes are built.
    """

    position: str
    bound: str
    top: str


def _levels(top: Column) -> Column:
    """0 .. number of bits of ``top + 1``: every block size a bound can need."""
    return F.sequence(F.lit(0), F.length(F.bin(top + 1)) - 1)


def _shift_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _block(level: Column, index: Column) -> Column:
    return F.struct(level.alias("level"), index.cast("bigint").alias("index"))


def _blocks_of_position(position: Column, top: Column) -> Column:
    """Blocks holding a position. Only even ones are ever part of a prefix."""
    blocks = F.transform(
        _levels(top), lambda level: _block(level, _shift_right(position, level))
    )
    return F.filter(blocks, lambda b: b["index"].bitwiseAND(F.lit(1)) == 0)


def _blocks_below(bound: Column, top: Column) -> Column:
    """The blocks whose union is the positions below ``bound``."""
    blocks = F.transform(
        _levels(top),
        lambda level: _block(level, _shift_right(bound, level) - 1),
    )
    return F.filter(blocks, lambda b: b["index"].bitwiseAND(F.lit(1)) == 0)


def best_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
) -> DataFrame:
    """The ``k`` first rows per key.

    Spark drops all but k rows per key in every map task before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(window))
        .filter(F.col("_place") <= k)
        .drop("_place")
    )


def _spread_out(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows over all shuffle partitions, before they are multiplied.

    Adaptive execution sizes tasks by the bytes they read; with a partition
    count of its own the stage that multiplies rows is not merged into few tasks.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *columns)


def _copies(level: Column) -> Column:
    """How many copies of a block are kept, a power of two."""
    extra = F.greatest(level - LEVEL_SERVED, F.lit(0))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), extra)


def prefix_top_k(
    candidates: DataFrame,
    queries: DataFrame,
    group: list[str],
    axes: list[Axis],
    query_key: list[str],
    k: int,
) -> DataFrame:
    """One row per query: its key and ``best``, the k smallest matching entries.

    ``candidates`` has the group, the axis positions and tops, and ``entry``, a
    struct whose ascending order says which candidate is better. ``queries`` has
    the group, a unique ``query_key``, and the axis bounds and tops. Queries
    without a match have no row.
    """
    spread = _spread_out(candidates, [*group, *[a.position for a in axes]])
    asked = _spread_out(queries, [*group, *[a.bound for a in axes]])
    for i, axis in enumerate(axes):
        spread = spread.withColumn(
            f"_block{i}",
            F.explode(_blocks_of_position(F.col(axis.position), F.col(axis.top))),
        )
        asked = asked.withColumn(
            f"_block{i}", F.explode(_blocks_below(F.col(axis.bound), F.col(axis.top)))
        )

    keys = [*group, *[f"_block{i}" for i in range(len(axes))]]
    copies = _copies(F.col("_block0.level"))
    kept = (
        best_per_key(spread.select(*keys, "entry"), keys, [F.asc("entry")], k)
        .groupBy(*keys)
        .agg(F.collect_list("entry").alias("_entries"))
        .withColumn(
            "_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))
        )
    )
    asked = asked.withColumn("_copy", F.pmod(F.col(axes[0].bound), copies)).select(
        *keys, "_copy", *[name for name in query_key if name not in keys]
    )
    # A query has at most k entries from each of its few blocks.
    merged = F.array_sort(F.flatten(F.collect_list("_entries")))
    return (
        asked.join(kept, [*keys, "_copy"])
        .groupBy(*query_key)
        .agg(F.slice(merged, 1, k).alias("best"))
    )


def skyband(
    candidates: DataFrame, group: list[str], axes: list[Axis], k: int
) -> DataFrame:
    """``candidates`` without rows that can be no query's k best.

    A row that k better rows with no higher position on any axis stand before
    serves nobody: each query that it matches, they match too. They are looked
    for in coarse cells (at most 2 ** BAND_BITS bands an axis, whatever the size of
    a group), in all bands below the row's own; its own band counts where a
    band is a single position. What stays may be more than needed, never less.
    """
    banded = candidates
    for i, axis in enumerate(axes):
        top = F.col(axis.top)
        shift = F.greatest(F.length(F.bin(top)) - BAND_BITS, F.lit(0))
        band = _shift_right(F.col(axis.position), shift)
        banded = banded.withColumns(
            {
                f"_band{i}": band,
                f"_limit{i}": band + F.when(shift == 0, 1).otherwise(0),
                f"_last{i}": _shift_right(top, shift),
            }
        )
    cell = [*group, *[f"_band{i}" for i in range(len(axes))]]
    made = [f"_{name}{i}" for i in range(len(axes)) for name in ("band", "limit", "last")]
    first = best_per_key(
        banded.select(*group, *made, "entry"), cell, [F.asc("entry")], k
    )
    better = prefix_top_k(
        first,
        first.select(*group, *made).distinct(),
        group=group,
        axes=[Axis(f"_band{i}", f"_limit{i}", f"_last{i}") for i in range(len(axes))],
        query_key=cell,
        k=k,
    )
    worst = better.filter(F.size("best") == k).select(
        *cell, F.element_at("best", k).alias("_worst")
    )
    return (
        banded.join(worst, cell, "left")
        .filter(F.col("_worst").isNull() | (F.col("entry") <= F.col("_worst")))
        .select(*candidates.columns)
    )
