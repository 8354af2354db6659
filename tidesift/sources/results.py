"""Sinks of comparison runs: each query's rows as Parquet, a JSON summary, and timings appended as CSV."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

TIMINGS = "query string, system string, started string, ms long, status string"


def run_all(spark: SparkSession, queries: Mapping[str, Callable[[], DataFrame]], folder: str, system: str = "spark") -> DataFrame:
    """Runs queries one after another and gives back their timings: query, system, started, ms (null if it failed), status.

    Below the folder, results/<query> holds its rows (overwritten), summary the timings of this run (JSON, overwritten) and
    timings those of all runs (CSV, appended). A query that fails is told in its status and doesn't stop the others.
    """
    top, rows = folder.rstrip("/"), []
    for name, make in queries.items():
        started, at = datetime.now(UTC).isoformat(timespec="milliseconds"), time.monotonic()
        try:
            make().write.mode("overwrite").parquet(f"{top}/results/{name}")
            rows.append((name, system, started, round(1000 * (time.monotonic() - at)), "OK"))
        except Exception as e:  # noqa: BLE001
            rows.append((name, system, started, None, f"failed: {type(e).__name__}"))
    timings = spark.createDataFrame(rows, TIMINGS).coalesce(1)
    timings.write.mode("overwrite").json(f"{top}/summary")
    timings.write.mode("append").option("header", "true").csv(f"{top}/timings")
    return timings
