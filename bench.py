"""Times the registered queries, streams included, and prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times with full
materialisation; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from flagframe.plans.queries import queries
from flagframe.session import local_session


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "flagframe-bench")
    chosen = os.environ.get("BENCH_QUERIES", "").split()
    known = queries()
    chosen = chosen or list(known)
    times = {}
    for name in chosen:
        run(known[name], spark, sf_dir)
        times[name] = round(statistics.median(run(known[name], spark, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "registered_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
