"""Tables that are replaced as a whole, and are never seen half written.

A table's folder holds one folder for each snapshot and an empty marker file for each
committed one, named by version and snapshot. A writer writes a new snapshot and only
then creates its marker, which a store does at once or not at all; nothing is renamed
or overwritten. Readers take the snapshot of the highest marker. So a failed write
leaves the table as it was, a table can be replaced by a query over itself, and a reader
in flight keeps its files until as many later versions as are kept have been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MARKERS, SNAPSHOTS = "_committed", "snapshots"


class _Folder:
    """A folder in whatever store its path names, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        if not self.system.exists(self.path):
            return []
        return sorted(status.getPath().getName() for status in self.system.listStatus(self.path))

    def create(self, name: str) -> None:
        self.system.mkdirs(self.path)
        if not self.system.createNewFile(self.child(name)):
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self.system.delete(self.child(name), True)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, snapshot) of what is committed, oldest first."""
    names = _Folder(spark, f"{path}/{MARKERS}").names()
    parts = [name.partition("-") for name in names if not name.startswith((".", "_"))]
    return sorted((int(version), snapshot) for version, _, snapshot in parts)


def replace_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """Make the rows of ``df`` the table; the last ``keep`` versions (1 at least) stay."""
    if keep < 1:
        raise ValueError("at least one version is kept")
    spark = df.sparkSession
    snapshot = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{path}/{SNAPSHOTS}/{snapshot}")
    version = max((v for v, _ in _versions(spark, path)), default=0) + 1
    markers = _Folder(spark, f"{path}/{MARKERS}")
    markers.create(f"{version:012d}-{snapshot}")
    folders = _Folder(spark, f"{path}/{SNAPSHOTS}")
    for old, name in _versions(spark, path)[:-keep]:
        markers.delete(f"{old:012d}-{name}")  # nobody finds it any more
        folders.delete(name)


def read_table(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The table's last version, or one of the kept ones before it.

    A folder without markers is read as plain Parquet.
    """
    versions = _versions(spark, path)
    if not versions:
        return spark.read.parquet(path)
    if not 0 <= back < len(versions):
        raise ValueError(f"{len(versions)} versions are kept")
    return spark.read.parquet(f"{path}/{SNAPSHOTS}/{versions[-1 - back][1]}")
