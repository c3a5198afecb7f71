"""

Usage: python tools/measure.py [sf_dir] [query ...]
Timing as in bench.py (one warm-up, median of three, query built and run through
the noop sink, cache
cleared); shuffle bytes and peak execution memory are read from Spark's
status store for the stages of the last timed run.
"""

from __future__ import annotations

import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from fleetsight.plans import registry  # noqa: E402
from fleetsight.session import get_session  # noqa: E402


def stages(store):
    """All stages in Spark's status store (a Scala Seq of v1 StageData)."""
    seq = store.stageList(None, False, False, getattr(store, "stageList$default$4")(),
                          getattr(store, "stageList$default$5")())
    return [seq.apply(i) for i in range(seq.size())]


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in argv[1:] if not a.startswith("/")] or list(HEADLINE.values())
    spark = get_session("local[8]", 16, extra={"spark.driver.memory": "16g"})
    registry.load_all()
    store = spark.sparkContext._jsc.sc().statusStore()
    print("| Query | Seconds (median of 3) | Shuffle write MB | Peak execution memory MB |")
    print("|---|---|---|---|")
    for name in names:
        fn = registry.QUERIES[name]
        spark.catalog.clearCache()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times = []
        for _ in range(3):
            spark.catalog.clearCache()
            before = {st.stageId() for st in stages(store)}
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        new = [st for st in stages(store) if st.stageId() not in before]
        shuffle = sum(s.shuffleWriteBytes() for s in new) / 1e6
        peak = max([s.peakExecutionMemory() for s in new] or [0]) / 1e6
        print(f"| {name} | {statistics.median(times):.3f} | {shuffle:.2f} | {peak:.1f} |")


if __name__ == "__main__":
    main(sys.argv)
