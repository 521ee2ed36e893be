"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores. Each query runs
once cold and once warm; the warm time counts, from building the plan to the last
row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import queries  # noqa: E402
from stationflow.session import get_session  # noqa: E402

HEADLINE = [
    "s7_lifecycle_fold",
    "w1_pick_pairs",
    "w3_dwell_pairs",
    "q01_throughput_station_hour",
    "q07_implied_share",
    "q08_picker_rate",
    "q13_pick_station_hour",
    "q16_pick_density",
    "q18_occupancy",
    "q21_switch_station_hour",
    "q26_demand_vs_cycle_fit",
    "q29_cycle_describe",
    "q31_bay_demand_wide",
    "q34_pareto_curve",
    "q35_queue_depth",
    "q36_leg_by_depth",
    "q39_fleet_timeline",
    "q43_daily_stats",
    "q47_day_changes",
    "q57_utilisation_chain",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    warm: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in HEADLINE:
        for seconds in (cold, warm):
            begin = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm wall time",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(folder).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
