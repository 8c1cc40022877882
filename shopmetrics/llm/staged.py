"""Staging of intermediate tables, with early release of shuffle files."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from shopmetrics.sources.staging import stage


def stage_and_release(df: DataFrame, name: str) -> DataFrame:
    """Stage ``df``, after shuffle files of plans that nobody holds any more may go.

    Spark deletes the shuffle files of a finished plan once the driver has
    collected its garbage, which a driver with little to do seldom does. The
    caller still holds ``df`` here; its files go when the next table is staged.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return stage(df, name)
