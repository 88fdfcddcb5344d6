"""Print, per named batch query, the operators that matter at scale.

Usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")

from eventscope.plans.catalog import QUERIES  # noqa: E402
from eventscope.session import build_session  # noqa: E402

WATCH = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
         "Exchange RoundRobinPartitioning", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "Expand", "TakeOrderedAndProject",
         "ObjectHashAggregate", "SortAggregate", "Generate", "BatchEvalPython", "ArrowEvalPython",
         "Subquery", "PushedFilters: [", "PartitionFilters: [i"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in QUERIES.items():
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = {w: len(re.findall(re.escape(w), plan)) for w in WATCH}
        print(f"{name:32s} " + ", ".join(f"{k.strip(': [')}={v}" for k, v in counts.items() if v))


if __name__ == "__main__":
    main()
