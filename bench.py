"""Times the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is run to the
end into a sink that discards the rows, so nothing is collected on the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from galeframe.plans.registry import PLANS, load_all
from galeframe.session import build_session

HEADLINE = [
    "rmse_by_site",
    "join_power_forecast",
    "lag_join_history",
    "latest_forecast_asof",
    "persistence_baseline",
    "rolling_stats",
    "lag_columns",
    "interpolate_linear",
    "interpolate_cubic",
    "minmax_fit_subset",
    "group_describe",
    "box_stats",
    "window_index",
    "window_tensor",
    "channel_swap",
    "sequence_dataset",
    "history_plus_run",
    "rmse_window_mean",
    "pinball_loss",
    "wind_rose",
    "power_curve",
    "feature_correlation",
    "per_site_apply",
    "recursive_forecast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            # As many partitions as cores: the tables are small in bytes, but a row unrolls
            # into a window of 84 or an array of 99, so merging them would idle the cores.
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    # Start the JVM's compilers and the Python workers outside the measurement.
    PLANS["rmse_by_site"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        begin = time.perf_counter()
        PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
