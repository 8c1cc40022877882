"""Cuts of a key's order into shards of about equal weight, the same in every run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.sources.staging import stage


def shard_bounds(df: DataFrame, key: str, weight: Column, target: int) -> list[int]:
    """Smallest key of each shard but the first.

    A shard is a range of keys of about ``target`` weight; rows with equal
    keys share one. Only keys and weights move. The list has total weight /
    ``target`` entries.
    """
    narrow = df.select(F.col(key).alias("k"), weight.cast("long").alias("w"))
    keys = narrow.where("k is not null").groupBy("k").agg(F.sum("w").alias("w"))
    placed = stage(
        stage(keys, "weights").repartitionByRange("k").withColumn("part", F.spark_partition_id()),
        "ranges",
    )
    totals = placed.groupBy("part").agg(F.sum("w").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    shard = F.floor((F.col("offset") + F.coalesce(F.sum("w").over(within), F.lit(0))) / target)
    lows = placed.join(totals, "part").select("k", shard.alias("shard"))
    rows = lows.groupBy("shard").agg(F.min("k").alias("low")).orderBy("shard").collect()
    return [r.low for r in rows[1:]]


def shard_of(key: str, bounds: list[int]) -> Column:
    """Number of the shard that a key lies in; null keys come first."""
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(), side="right"))

    return F.when(F.col(key).isNull(), F.lit(0).cast("long")).otherwise(
        place(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")))
    )
