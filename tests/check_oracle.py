"""Compare registered queries with their SQL answers.

Usage: python tests/check_oracle.py [data folder] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(v)) for v in row)


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> str:
    """Empty text when rows agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(_value(v) for v in r) for r in df.select(columns).collect()), key=_key)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if mine else "no rows"
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return f"columns {columns} against {sorted(relation.columns)}"
    types = dict(zip(relation.columns, map(str, relation.types)))
    plain = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
             "boolean": "BOOLEAN"}
    odd = {c: (t, types[c]) for c, t in df.dtypes if plain.get(t) != types[c]}
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted(
        (tuple(_value(r[i]) for i in order) for r in relation.fetchall()), key=_key
    )
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if different:
        return f"{len(different)} of {len(mine)} rows differ, first {different[0]}"
    return f"types {odd}" if odd else ""


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in entry.queries():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
