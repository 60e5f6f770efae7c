"""Headline queries timed on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mealops.catalog import all_queries  # noqa: E402
from mealops.session import local_session  # noqa: E402

HEADLINE = [
    "a05_slot_summary",          # flagship
    "j11_previous_distinct",     # prior different restaurant
    "j07_work_ratio",            # roster, orders per slot, work/order ratio
    "w05_avg_on_hand",           # orders on hand, time weighted
    "w01_experience", "w02_shifts", "w08_lag_orders", "w10_rider_month_running",
    "a12_summary_stats", "a20_box_leave_by_lead", "u03_choice_set", "x09_restaurant_master",
    "m02_ols_two", "m04_fixed_effects", "m17_threshold_contrast",
    "build_features", "build_model_sample",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = all_queries()
    orders = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    # one small run so that the first query does not pay for class loading
    queries["a05_slot_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rate = {n: round(orders / seconds[n]) for n in ("j11_previous_distinct", "j07_work_ratio", "w05_avg_on_hand")}
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "orders_per_second": rate, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
