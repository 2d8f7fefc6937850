"""Headline-query benchmark: prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list to restrict).  Each query is run to completion with
the ``noop`` sink (full execution, nothing collected) after one warm-up of the
session; the value is the sum of per-query wall seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "load_all_grains",        # A4: three grains in one scan
    "panel_region",           # A2 + A5 + T2 + J1 + J2: full regional panel
    "total_forecast",         # F3 + F17: rolling day-ahead national forecast (flagship)
    "per_client_forecast",    # F5
    "backtest_leaderboard",   # F10 + F11
    "holdout_summary",        # F16 + A17 + A18
    "local_validation",       # F14
    "client_features",        # C1
    "target_transforms",      # F6
    "tree_forecast",          # F8: fit + rolling scoring
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from wattline.session import get_session
    from wattline.plans.catalog import REGISTRY

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=cpus * 2)
    spark.read.parquet(os.path.join(sf_dir, "events.parquet")).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in (only or HEADLINE):
        fn = REGISTRY[name][0]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
