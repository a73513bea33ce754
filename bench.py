"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores,
BENCH_REPEATS the timed runs of a query (their median counts). Queries named as arguments
replace the headline ones. One untimed query warms the session up.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brackish.plans.catalog import QUERIES  # noqa: E402
from brackish.session import local_session  # noqa: E402

HEADLINE = (
    "nearest_noon",
    "assign_subregion",
    "drop_high_outliers",
    "seasonal_index_relaxed",
    "seasonal_index_zone",
    "low_salinity_zone",
    "sampling_effort",
    "water_year_flow",
    "flow_with_series",
    "plankton_biomass",
    "composition",
    "corrected_summary",
    "monthly_salinity_grid",
    "scenario_ratio",
    "anova2",
    "grouped_lm",
    "box_summary",
    "histogram_counts",
    "hydro_smooth",
    "response_surface",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(cpus, "16g", "brackish-bench")
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    names = sys.argv[1:] or HEADLINE
    run("season_year")
    times = {name: round(statistics.median(run(name) for _ in range(repeats)), 3) for name in names}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
