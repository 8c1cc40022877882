"""De-duplication, repair, clipping and outlier flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics import fixed_values as V
from shopmetrics.functions.mathx import clip
from shopmetrics.operators.normalize import normalize_primary
from shopmetrics.operators.prefix_topk import best_per_key
from shopmetrics.operators.ranking import exact_quantiles
from shopmetrics.schema import (
    ARRIVAL,
    OUTLIER_COLUMN,
    PRODUCT_COLUMNS,
    SOURCE_RANK,
    order_columns,
)

REQUIRED = ["product_id", "product_name", "price"]
# Tasks that the copies of one key are dealt to before the first of them is found.
DEALT = 8
# Types whose smallest value Spark keeps in a hash table, without sorting rows.
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _arrival_order(df: DataFrame) -> list[str]:
    """Columns deciding which copy came first, nulls last.

    Where a source may not state it, the other columns settle ties, so that the
    outcome never depends on partitioning.
    """
    stated = order_columns(df)
    rest = [] if ARRIVAL in stated else sorted(set(df.columns) - set(stated))
    return stated + rest


def _lead(df: DataFrame, name: str) -> Column | None:
    """The field that decides first in an order column, if it has a fixed width."""
    at, kind = F.col(name), df.schema[name].dataType
    while isinstance(kind, T.StructType) and kind.fields:
        at, kind = at.getField(kind.fields[0].name), kind.fields[0].dataType
    return at if isinstance(kind, FIXED_WIDTH) else None


def _contenders(df: DataFrame, key: str) -> DataFrame:
    """Rows that may be the first of their key: no row of their source leads theirs.

    The smallest leading field of each key (an order number, say) is a hash
    aggregate of two or three plain columns: it needs no sort, holds one entry per key
    and not per row, and copies that lie together are one row before the shuffle.
    The rows are matched with it by ``exists``, a condition that Spark pushes below the
    joins and expressions that make rows wide, as it would not push a join; its
    smaller side is hashed, so rows aren't sorted either. A row's source and the first arrival column it has (``_slot``) are
    part of the group, so that only one leading field is compared. ``df`` is read
    twice; its arrival must be stated by the rows and not drawn while they are read.
    """
    stated = order_columns(df)
    arrivals = [name for name in stated if name != SOURCE_RANK]
    leads = [_lead(df, name) for name in arrivals]
    if not any(lead is not None for lead in leads):
        return df
    slot = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(arrivals)])
    marked = df.withColumn("_slot", slot)
    marks, least = [], []
    for i, lead in enumerate(leads):
        if lead is None:
            continue
        mark, own = f"_lead{i}", F.col("_slot") == i
        marked = marked.withColumn(mark, F.when(own, lead))
        # A field of a struct sorts nulls first, a whole order column last.
        none = F.max(own & F.col(mark).isNull())
        least.append(F.when(none, F.lit(None)).otherwise(F.min(mark)).alias(f"_first{mark}"))
        marks.append(mark)
    by = [key, *[name for name in stated if name == SOURCE_RANK], "_slot"]
    first = marked.groupBy(*[F.col(name).alias(f"_first{name}") for name in by]).agg(*least)
    # Names that the aggregate lacks: it would take others for its own columns.
    own = marked.withColumns({f"_own{name}": F.col(name) for name in [*by, *marks]})
    for name in [*by, *marks]:
        first = first.where(F.col(f"_first{name}").eqNullSafe(F.col(f"_own{name}").outer()))
    return own.where(first.hint("shuffle_hash").exists()).select(*df.columns)


def keep_first(df: DataFrame, key: str) -> DataFrame:
    """First arrived row per key.

    Where rows state their arrival, those that another one of the key leads are left
    out before any row is sorted (``_contenders``). The rest is dealt by key before it
    is sorted: a task sorts one shuffle partition, however large the pieces are that
    the input is read in. ``DEALT`` tasks share a key, so one with very many copies
    isn't left to a single task; at most ``DEALT`` rows per key go through the second
    shuffle.
    """
    names = _arrival_order(df)
    order = [F.col(name).asc_nulls_last() for name in names]
    share = F.pmod(F.xxhash64(*names), F.lit(DEALT))
    dealt = _contenders(df, key).repartition(F.col(key), share)
    return best_per_key(dealt, [key], order, 1)


def dedup_raw(df: DataFrame, key: str = "id") -> DataFrame:
    return keep_first(df, key)


def dedup_counts(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows before and after ``dedup_raw`` and the number of copies."""
    return (
        df.agg(
            F.count(F.lit(1)).alias("rows_before"),
            (
                F.count_distinct(key)
                + F.coalesce(F.max(F.col(key).isNull()).cast("bigint"), F.lit(0))
            ).alias("rows_after"),
        )
        .withColumn("duplicates", F.col("rows_before") - F.col("rows_after"))
    )


def _without_missing(df: DataFrame, names: list[str]) -> DataFrame:
    """``dropna`` as one plain condition a column, which Spark can push to the scan each."""
    for name in names:
        df = df.filter(F.col(name).isNotNull())
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            df = df.filter(~F.isnan(name))
    return df


def drop_incomplete(df: DataFrame) -> DataFrame:
    return _without_missing(df, REQUIRED)


def fill_defaults(df: DataFrame) -> DataFrame:
    """Defaults for what is null; normalised primary rows have no nulls here."""
    defaults = {
        "shop": F.lit(V.PRIMARY_PLATFORM),
        "category": F.lit(V.UNKNOWN_CATEGORY),
        "list_price": F.col("price"),
        "discount_ratio": F.lit(0.0),
        "units_sold": F.lit(0).cast("bigint"),
        "rating": F.lit(0.0),
        "platform": F.lit(V.UNKNOWN_PLATFORM),
        "url": F.lit(""),
    }
    return df.withColumns(
        {name: F.coalesce(F.col(name), value) for name, value in defaults.items()}
    )


def dedup_products(df: DataFrame) -> DataFrame:
    return keep_first(df, "product_id")


def clip_ranges(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "rating": clip(F.col("rating"), 0.0, 5.0),
            "discount_ratio": clip(F.col("discount_ratio"), 0.0, 1.0),
            "units_sold": F.col("units_sold").cast("bigint"),
        }
    )


def positive_price(df: DataFrame) -> DataFrame:
    return df.filter(F.col("price") > 0)


def price_bounds_for_outliers(df: DataFrame) -> DataFrame:
    """One row: quartiles, mean and sample deviation of the price."""
    quartiles = exact_quantiles(df, "price", {"q1": 0.25, "q3": 0.75}).select(
        F.struct("q1", "q3")
    )
    moments = df.agg(F.avg("price").alias("mean"), F.stddev_samp("price").alias("std"))
    return moments.withColumn("q", quartiles.scalar()).select(
        "q.q1", "q.q3", "mean", "std"
    )


def flag_price_outliers(
    df: DataFrame,
    iqr_multiplier: float = V.IQR_MULTIPLIER,
    z_threshold: float = V.Z_THRESHOLD,
) -> DataFrame:
    """Flag prices outside the quartile fences or too many deviations off."""
    bounds = price_bounds_for_outliers(df)
    q1, q3 = F.col("q1"), F.col("q3")
    fences = bounds.select(
        F.struct(
            (q1 - iqr_multiplier * (q3 - q1)).alias("low"),
            (q3 + iqr_multiplier * (q3 - q1)).alias("high"),
            "mean",
            (F.col("std") + V.STD_EPSILON).alias("std"),
        )
    ).scalar()
    price = F.col("price")
    outside = (price < fences["low"]) | (price > fences["high"])
    score = F.abs((price - fences["mean"]) / fences["std"])
    flag = F.coalesce(outside, F.lit(False)) | F.coalesce(
        score > z_threshold, F.lit(False)
    )
    return df.withColumn(OUTLIER_COLUMN, flag)


def outliers(df: DataFrame) -> DataFrame:
    return df.filter(F.col(OUTLIER_COLUMN))


def clean_unflagged(df: DataFrame) -> DataFrame:
    """Every cleaning step before the outlier flag, in order.

    Raw rows lose incomplete rows and later copies before they are normalised:
    neither step needs more than id and name (a raw price is never missing), so
    texts are only parsed for rows that stay.
    """
    if "product_id" in df.columns:
        unique = dedup_products(fill_defaults(drop_incomplete(df)))
    elif {"id", "name"} <= set(df.columns):
        unique = normalize_primary(keep_first(_without_missing(df, ["id", "name"]), "id"))
    else:
        unique = dedup_products(fill_defaults(drop_incomplete(normalize_primary(df))))
    return positive_price(clip_ranges(unique)).select(*PRODUCT_COLUMNS)


def clean_products(
    df: DataFrame,
    iqr_multiplier: float = V.IQR_MULTIPLIER,
    z_threshold: float = V.Z_THRESHOLD,
) -> DataFrame:
    """Raw or normalised rows to the flagged product table, as one lazy plan.

    The fences need a first pass over the prices; stage the result of
    ``clean_unflagged`` and call ``flag_price_outliers`` on it to read the raw
    rows only once.
    """
    return flag_price_outliers(clean_unflagged(df), iqr_multiplier, z_threshold)


def cleaning_audit(df: DataFrame) -> DataFrame:
    """Rows in and out of every cleaning step.

    One pass over normalised rows: incomplete rows are counted under one null
    key, the others per product together with the price of their first copy.
    """
    complete = F.lit(True)
    for name in REQUIRED:
        complete = complete & F.col(name).isNotNull()
    # Struct fields would sort nulls first.
    first = F.struct(
        *[e for c in _arrival_order(df) for e in (F.col(c).isNull(), F.col(c))]
    )
    per_product = (
        df.withColumn("_key", F.when(complete, F.col("product_id")))
        .groupBy("_key")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min_by("price", first).alias("_price"),
        )
    )
    real = F.col("_key").isNotNull()
    counts = per_product.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(real, F.col("_rows"))), F.lit(0)).alias("n_complete"),
        F.count_if(real).alias("n_unique"),
        F.count_if(real & (F.col("_price") > 0)).alias("n_clean"),
    )
    prices = per_product.filter(real).select(F.col("_price").alias("price"))
    flagged = flag_price_outliers(positive_price(prices)).agg(
        F.count_if(OUTLIER_COLUMN)
    )
    counts = counts.withColumn("n_flagged", flagged.scalar())

    def step(number: int, name: str, rows_in: str, rows_out: str) -> Column:
        return F.struct(
            F.lit(number).alias("step_no"),
            F.lit(name).alias("step"),
            F.col(rows_in).alias("rows_in"),
            F.col(rows_out).alias("rows_out"),
        )

    return (
        counts.select(
            F.explode(
                F.array(
                    step(1, "drop_incomplete", "n_rows", "n_complete"),
                    step(2, "dedup_products", "n_complete", "n_unique"),
                    step(3, "positive_price", "n_unique", "n_clean"),
                    step(4, "flag_outliers", "n_clean", "n_flagged"),
                )
            ).alias("s")
        )
        .select("s.*")
        .withColumn(
            "pct_out",
            F.round(F.try_divide(F.col("rows_out") * 100.0, F.col("rows_in")), 6),
        )
    )
