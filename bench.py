"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries",
"sf", ...}. Each query is timed to full materialisation (a write to the noop
sink, so nothing is gathered on the driver). One untimed pass over all
queries first warms the JVM (JIT, generated code); each query is then timed
as the best of $BENCH_RUNS runs (default 3; queries on stores: 1). Each run builds the query from
scratch (plan construction is part of the time). $BENCH_CONF takes extra
Spark settings as "key=value,key=value".
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from overhaul import build_session, suite  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(suite.QUERIES)
    extra = dict(kv.split("=", 1) for kv in os.environ.get("BENCH_CONF", "").split(",") if kv)
    spark = build_session(f"local[{cpus}]", int(cpus) * 2, extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    def once(name):
        t0 = time.perf_counter()
        suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in names:
        once(name)
    # Queries on a store of their own write all its tables first: one run each.
    times = {name: round(min(once(name) for _ in range(1 if name.startswith("store_") else runs)), 3) for name in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
