"""Summarise the executed (AQE final) plan of every registered query.

Usage: python tools/plan_survey.py [sf_dir]
Prints per query the number of exchanges, reused exchanges and scans, and
flags sort-based/object aggregates, sort-merge joins, expands and any
cartesian or nested-loop join.
"""

import sys, re
sys.path.insert(0, "/root/repo")
from fleetsight.session import get_session
from fleetsight.plans import registry
spark = get_session("local[8]", 16)
registry.load_all()
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
for name in sorted(registry.QUERIES):
    df = registry.QUERIES[name](spark, sf)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    final = p.split("== Initial Plan ==")[0] if "== Initial Plan ==" in p else p
    flags = []
    for k in ["SortAggregate", "BroadcastNestedLoopJoin", "CartesianProduct", "ObjectHashAggregate", "SortMergeJoin", "Expand"]:
        n = final.count(k)
        if n: flags.append(f"{k}={n}")
    print(f"{name:34s} exch={final.count('Exchange'):2d} reused={final.count('Reused'):d} scans={final.count('Scan parquet'):d} {' '.join(flags)}")
