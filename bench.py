"""Times the whole jobs on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

Each job is first run once on the smallest data in the same session, untimed, so that the
figures hold no start-up of the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.registry import QUERIES  # noqa: E402
from slopeweave.session import local_session  # noqa: E402

JOBS = ["q1_segment", "q2_dem", "q3_evaluate", "q4_sweep"]


def run(name: str, spark, data: str) -> float:
    started = time.time()
    QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
    return round(time.time() - started, 2)


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    small = os.path.join(os.path.dirname(data.rstrip("/")), "sf0.001")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(small):
        for name in JOBS:
            run(name, spark, small)
    times = {name: run(name, spark, data) for name in JOBS}
    print(json.dumps({"metric": "whole jobs, total wall time", "value": round(sum(times.values()), 2), "unit": "sec",
                      "queries": times, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
