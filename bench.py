"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinelane.queries import all_queries  # noqa: E402
from kinelane.session import local_session  # noqa: E402

HEADLINE = [
    "parse_lines",
    "doc_lines",
    "series_positions",
    "moving_average",
    "rolling_moments",
    "differences",
    "integrate",
    "motion_features",
    "savgol_full",
    "savgol_nearest",
    "sliding_windows",
    "sliding_windows_dense",
    "segment_features",
    "forecast_windows",
    "peaks_all",
    "peaks_distance",
    "peaks_prominence",
    "minmax_series",
    "standardise",
    "class_describe",
    "class_report",
    "verdict_majority",
    "noise",
    "resample_linear",
    "resample_cubic",
    "split_stratified",
    "silhouette",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    found = all_queries()
    names = sys.argv[1:] or HEADLINE
    # One small run first, so that no query pays for starting the JVM and the Python workers.
    found["series_positions"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        found[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
