"""Run queries and summarise their final (adaptive) physical plans.

Usage: python tools/plan_report.py [sf_dir] [name ...]
Prints, per query, the counts of shuffles and join / aggregate strategies in
the executed plan, plus scan pruning (ReadSchema) and pushed filters.
"""

from __future__ import annotations

import collections
import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

KEYS = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
        "BroadcastNestedLoopJoin", "CartesianProduct", "WindowGroupLimit", "Window", "Expand", "HashAggregate",
        "ObjectHashAggregate", "SortAggregate", "Generate", "FlatMapGroupsInPandas", "ArrowEvalPython",
        "BatchEvalPython", "ReusedExchange", "FileScan"]


def final_only(plan: str) -> str:
    """Drop every '== Initial Plan ==' section of an adaptive plan string."""
    out, skip, depth = [], False, 0
    for line in plan.splitlines():
        if "== Initial Plan ==" in line:
            skip, depth = True, len(line) - len(line.lstrip(" :|+-"))
            continue
        if skip:
            d = len(line) - len(line.lstrip(" :|+-"))
            if d >= depth:
                continue
            skip = False
        out.append(line)
    return "\n".join(out)


def summarize(plan: str) -> dict:
    counts = collections.Counter()
    for line in final_only(plan).splitlines():
        m = re.match(r"^[\s:+\-*()\d]*([A-Za-z]+)", line)
        if m and m.group(1) in KEYS:
            counts[m.group(1)] += 1
    return dict(counts)


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")]
    from tailorspark.plans.registry import all_queries
    from tailorspark.session import get_session

    spark = get_session("local[8]")
    qs = all_queries()
    for n in names:
        df = qs[n](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"== {n}: {summarize(plan)}")
        for line in final_only(plan).splitlines():
            if "FileScan" in line or "Scan parquet" in line:
                rs = re.search(r"ReadSchema: (struct<[^>]*>)", line)
                pf = re.search(r"PushedFilters: (\[[^\]]*\])", line)
                tbl = re.search(r"/([a-z]+)\.parquet", line)
                print(f"   scan {tbl.group(1) if tbl else '?'}: {rs.group(1) if rs else ''} "
                      f"{('pushed ' + pf.group(1)) if pf and pf.group(1) != '[]' else ''}")


if __name__ == "__main__":
    main()
