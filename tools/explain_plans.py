"""Summarize the physical plans of registered queries: shuffle exchanges (by key), joins by
strategy, window operators, Python operators, Parquet pushdown. Writes PLANS.md.

usage: python tools/explain_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = ["score_record", "feature_vector", "velocity_features", "velocity_batch",
           "anchored_counter", "history_interval_join", "hourly_rollup", "daily_summary",
           "high_risk_transactions", "top_per_user", "roc_auc", "chrono_split",
           "user_velocity_tvf", "lookup_by_key", "build_profiles"]


def summarize(plan: str) -> dict:
    ex = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)\(?([^\n]*?)\)?, ENSURE", plan)
    return {
        "shuffles": [f"{k}({re.sub(r'#[0-9]+L?', '', v)[:60]})" for k, v in ex],
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": {j: plan.count(j) for j in ("SortMergeJoin", "BroadcastHashJoin",
                                             "ShuffledHashJoin", "BroadcastNestedLoopJoin",
                                             "CartesianProduct") if plan.count(j)},
        "windows": len(re.findall(r"\bWindow(GroupLimit)? ", plan)),
        "window_group_limit": "WindowGroupLimit" in plan,
        "take_ordered": "TakeOrderedAndProject" in plan,
        "python": sorted(set(re.findall(r"(BatchEvalPython|ArrowEvalPython|MapInPandas|"
                                        r"FlatMapGroupsInPandas|PythonUDF)", plan))),
        "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))[:3],
    }


def main():
    from riskloom.plans import catalog
    from riskloom.session import build_session
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    catalog.MEMO_ENABLED = False
    spark = build_session("local[8]", 16, extra={"spark.sql.adaptive.enabled": "false",
                                                         "spark.sql.autoBroadcastJoinThreshold": "-1"})
    out = ["# Physical plans (AQE and automatic broadcasts off: the plan of large tables)", "",
           f"Data: `{sf}`. Generated by `tools/explain_plans.py`.", ""]
    for n in args or DEFAULT:
        df = catalog.QUERIES[n](spark, sf)
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        out += [f"## {n}", "",
                f"* shuffle exchanges ({len(s['shuffles'])}): " + "; ".join(s["shuffles"]),
                f"* broadcast exchanges: {s['broadcasts']}; joins: {s['joins']}",
                f"* window operators: {s['windows']}; group-limit: {s['window_group_limit']}; "
                f"TakeOrderedAndProject: {s['take_ordered']}",
                f"* Python operators: {s['python'] or 'none'}",
                f"* pushed filters: {s['pushed'] or '-'}", ""]
        print(n, len(s["shuffles"]), s["joins"], s["python"], flush=True)
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                           "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
