"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times; its figure is the median of reading its whole result.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidesift import workload
from tidesift.session import get_spark

HEADLINE = [f"tpch_q{n}" for n in range(1, 23)] + ["join_hash", "join_pushdown", "agg_bucketed", "bloom_contains", "steps_broadcast_join", "task_overlap"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = workload.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
