"""Benchmark the headline queries.

Runs each query on the tables in $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS]: one warm-up, then the median of three timed runs, each
forcing the whole result through the ``noop`` sink. Prints one JSON line.
Set BENCH_ALL=1 to time every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetsight.plans import registry  # noqa: E402
from fleetsight.session import get_session  # noqa: E402

HEADLINE = {
    "d2_top_workload": "d2_top_workload_by_duration",
    "a1_merge": "a1_snapshot_merge_reported",
    "a2_history": "a2_append_history",
    "a4_change_report": "a4_change_report",
    "c9_counters": "c9_accumulate_log",
    "c8_calendar_rollup": "c8_rollup_week_hour_working",
    "e1_last_n": "e1_last_n_backups",
    "e2_compliance": "e2_schedule_compliance",
    "d8_duplicates": "d8_duplicate_signatures",
    "g1_null_profile": "g1_null_profile",
    "g3_text_search": "g3_search_text",
}


def run_once(spark, fn, sf_dir) -> float:
    """Build the query (eager steps such as size checks or iterative loops
    count) and force the whole result through the noop sink."""
    spark.catalog.clearCache()   # nothing cached survives from one run to the next
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = get_session(f"local[{cpus}]", int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    registry.load_all()
    names = dict(HEADLINE)
    if os.environ.get("BENCH_ALL") == "1":
        names = {k: k for k in registry.QUERIES}
    results, failed = {}, {}
    for label, qname in names.items():
        fn = registry.QUERIES[qname]
        try:
            run_once(spark, fn, sf_dir)  # warm-up (plan, JIT, file cache)
            times = [run_once(spark, fn, sf_dir) for _ in range(reps)]
            results[label] = round(statistics.median(times), 3)
        except Exception as e:  # noqa: BLE001 - report and go on with the other queries
            failed[label] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total_median", "value": round(sum(results.values()), 3), "unit": "sec",
           "queries": results, "sf": sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
