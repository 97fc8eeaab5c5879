"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is fully materialised with the no-op sink (not a count, which
Catalyst could prune), after one untimed warm-up. The operators' own output is
timed, without the text form that the oracle comparison needs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabclean.plans import registry  # noqa: E402
from tabclean.session import build_session  # noqa: E402

HEADLINE = [
    "profile_lineitem", "top_values_events", "summary_orders", "auto_clean", "manual_clean",
    "fill_median", "dedupe", "filter_all", "outliers", "one_hot", "label_encode", "label_encode_text",
    "scale_lineitem", "suggest_plan", "csv_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    registry.RENDER = False
    queries = registry.QUERIES
    queries["summary_customer"](spark, sf_dir)  # warm-up: JVM, codegen, file listing
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus, "driver_memory": spark.conf.get("spark.driver.memory"), "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
