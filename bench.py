"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query is written to Spark's
``noop`` sink, so all of its rows are computed. The better of two timed runs counts; a first run
warms up the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sluiceway.plans import QUERIES
from sluiceway.session import local_session

HEADLINES = {
    "tokenize": "documents",
    "word_count": "documents",
    "running_count": "documents",
    "hash_channel_string": "events",
    "rebalance_channel": "events",
    "route_by_table": "events",
    "window_join": "events",
    "anchored_window": "events",
    "window_join_anchored": "events",
    "new_sellers_anchored": "events",
    "changelog_view": "events",
    "mode_switch_marker": "events",
    "stream_running_count": "documents",
    "stream_window_join_anchored": "events",
    "handover": "events",
}


def run(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"))
    sizes = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(HEADLINES.values())}
    seconds = {}
    for name in HEADLINES:
        run(spark, sf_dir, name)
        seconds[name] = round(min(run(spark, sf_dir, name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rates = {n: round(sizes[t] / max(seconds[n], 1e-9)) for n, t in HEADLINES.items()}
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
