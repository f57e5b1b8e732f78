"""Time the headline queries and print one JSON line.

The test ledger is derived from the driver's tables and written out first, as a ledger would be
stored; ``prepare`` is the time that takes, and is not part of ``value``.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8) and ``BENCH_RUNS`` (timed runs per
query after one warm-up, the median counts; default 3) set what is run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgermatch.sources.fixtures import Fixtures  # noqa: E402
from verification.queries import QUERIES  # noqa: E402

HEADLINE = (
    "dashboard_counts",
    "exception_aging",
    "value_dashboard",
    "summ_default",
    "summ_pivot",
    "match_one_to_one",
    "match_many_to_many",
    "match_partial",
    "match_rules_in_order",
    "match_fixpoint",
    "exception_report",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgermatch-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # A rule sequence is one long stage with more generated classes than the default keeps.
        .config("spark.sql.codegen.cache.maxEntries", "5000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    start = time.perf_counter()
    Fixtures.store(spark, sf_dir, tempfile.mkdtemp(prefix="ledgermatch-bench-"))
    prepare = round(time.perf_counter() - start, 3)
    times = {}
    for name in HEADLINE:
        seconds(spark, name, sf_dir)
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "prepare": prepare,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
