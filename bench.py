"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Two passes, apart: ``queries`` are cold (every query reads the raw tables and builds all it
needs, as ``queries()`` does for anyone who calls it); ``cached`` are the same queries in pipeline
order over a session that keeps log, profiles, features and scores in memory, as a deployment
that scores once and then answers analytics. Each query is executed to a ``noop`` sink, which runs
every stage without collecting rows to the driver. Before timing, every query runs once on the smallest
data set (JIT and generated code warm-up; reported as ``warmup``). Prints one JSON line:
{"metric", "value" (sum of cold query seconds), "unit", "queries", "cached", "sf", "rows", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "score_record",            # flagship: 34 features + rule score + level/decision/factors
    "feature_vector",          # P20: all point-in-time features
    "velocity_features",       # W8
    "velocity_batch",          # W10
    "recent_history",          # W9
    "history_interval_join",   # J4
    "anchored_counter",        # W12
    "rate_limit",              # W13
    "build_profiles",          # A10
    "hourly_rollup",           # A3 (exact percentiles)
    "daily_summary",           # A2
    "latency_summary",         # A7
    "high_risk_transactions",  # J3
    "top_per_user",            # T3
    "roc_auc",                 # M7
    "pr_curve",                # M9
    "chrono_split",            # M1
    "user_velocity_tvf",       # X1
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from riskloom.plans import catalog
    from riskloom.session import build_session
    catalog.MEMO_ENABLED = False
    spark = build_session(f"local[{cpus}]", int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # Warm-up: every query once on the smallest data next to sf_dir (JIT + generated code for
    # the same plan shapes, as in a long-running service), timed separately as "cold".
    warm_dir = os.environ.get("BENCH_WARM_DIR", re.sub(r"sf[0-9.]+", "sf0.001", sf_dir))
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    cold = {}
    for n in names:
        t0 = time.perf_counter()
        catalog.QUERIES[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
        cold[n] = round(time.perf_counter() - t0, 3)
    spark.catalog.clearCache()

    def timed() -> dict:
        out = {}
        for n in names:
            t0 = time.perf_counter()
            catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            out[n] = round(time.perf_counter() - t0, 3)
        return out

    times = timed()
    catalog.MEMO_ENABLED = True
    cached = timed()
    log_rows = catalog.QUERIES["feat_amount"](spark, sf_dir).count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times,
           "cached": {"value": round(sum(cached.values()), 3), "queries": cached}, "sf": float(m.group(1)) if m else sf_dir,
           "rows": {"transactions": log_rows},
           "warmup": {"dir": warm_dir, "total_seconds": round(sum(cold.values()), 3)},
           "throughput_rows_per_s": {"score_record": round(log_rows / times["score_record"], 1)
                                     if times.get("score_record") else None}}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
