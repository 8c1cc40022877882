"""Time the registered queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (cores), BENCH_ONLY (comma
separated query name prefixes, for iterating on a few).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shopmetrics.plans import catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ONLY = tuple(p for p in os.environ.get("BENCH_ONLY", "").split(",") if p)
# Faster queries are run once more, warm, and that run counts.
RERUN_BELOW_SECONDS = 10.0


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("shopmetrics-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shopmetrics-bench-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    seconds = {
        "build_products": timed(lambda: catalog.products(spark, SF_DIR)),
        "build_two_sources": timed(lambda: catalog.two_source_products(spark, SF_DIR)),
        "build_scored": timed(lambda: catalog.scored(spark, SF_DIR)),
        "build_advised": timed(lambda: catalog.advised(spark, SF_DIR)),
    }
    for name, query in catalog.QUERIES.items():
        if ONLY and not name.startswith(ONLY):
            continue

        def once(query=query) -> None:
            run(query(spark, SF_DIR))

        seconds[name] = timed(once)
        if seconds[name] < RERUN_BELOW_SECONDS:
            seconds[name] = timed(once)
        print(f"{name} {seconds[name]:.2f}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
