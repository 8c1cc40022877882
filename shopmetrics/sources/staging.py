"""Tables written once and read many times.

A staged table is Parquet in the folder the session names in
``spark.checkpoint.dir``. Unlike an RDD checkpoint it keeps column pruning and
filter push-down for its readers, and unlike a cached table it survives the
loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    A local session without the setting gets a new temporary folder; on a
    cluster such a folder would not be shared, so there the setting is needed.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="shopmetrics-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the staging root that no other run uses."""
    run = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/shopmetrics/{run}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and return a reader of the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
