"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query writes to Spark's no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from acctpulse.registry import ANALYSES  # noqa: E402
from acctpulse.session import local_session, release  # noqa: E402

HEADLINES = (
    "trailing_median",
    "user_activation",
    "capability_reach",
    "stickiness_utilization",
    "term_to_date_updated",
    "financial_metrics",
    "support_metrics",
    "latest_invoice",
    "competitor_monthly",
    "account_360",
    "metric_percentiles",
    "health_score",
    "health_score_360",
    "weekly_spine",
    "lag_features",
    "scd_presence",
    "competitor_weekly",
    "churn_features",
    "null_profile",
    "impute_segment_median",
    "segment_correlation",
    "segment_ols_metrics",
    "segment_vif_metrics",
    "median_percentiles",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "acctpulse-bench", shared=f"file://{tempfile.mkdtemp(prefix='acctpulse-')}")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    # Loading classes and compiling the first plans is not a query's time.
    ANALYSES["group_all_agg"](spark, directory).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        ANALYSES[name](spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(directory).name.removeprefix("sf"),
                "cpus": int(cpus) if cpus.isdigit() else cpus,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
