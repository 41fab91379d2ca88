"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then is timed over $BENCH_REPEAT runs (median).
Results are materialised with the ``noop`` sink, so the full plan executes
without shipping rows to the driver, and nothing that a run has kept is left to
the next one.  Prints one JSON line.  ``calibration`` is the time of a fixed query
on generated numbers, outside the total: it tells the speed of the machine from that
of the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from churnwise.plans.catalog import REGISTRY  # noqa: E402
from churnwise.session import get_session  # noqa: E402


def run_once(spark, name: str, sf: str) -> float:
    spark.catalog.clearCache()
    t0 = time.perf_counter()
    REGISTRY[name].run(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def calibration(spark) -> float:
    """Seconds of a fixed aggregation over 50 million generated numbers."""
    t0 = time.perf_counter()
    numbers = spark.range(0, 50_000_000, 1, 32)
    numbers.groupBy((F.xxhash64("id") % 100_000).alias("k")).agg(F.sum("id"), F.max(F.sqrt("id"))).write.format(
        "noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or [n for n, q in REGISTRY.items() if q.headline]
    spark = get_session()
    out = {}
    for name in names:
        run_once(spark, name, sf)
        out[name] = round(statistics.median(run_once(spark, name, sf) for _ in range(repeat)), 3)
    fixed = round(statistics.median(calibration(spark) for _ in range(repeat + 1)), 3)
    scale = os.path.basename(sf.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": scale,
                      "cpus": int(os.environ.get("BENCH_CPUS", "8")), "calibration": fixed}))


if __name__ == "__main__":
    main()
