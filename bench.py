"""Times the headline queries and prints one JSON line.

Two untimed queries start the JVM and its Python workers before the clock does.
"""

from __future__ import annotations

import json
import os
import time

from plumbline.plans.catalog import QUERIES
from plumbline.session import local_session

HEADLINE = (
    "quality_score",
    "column_unique",
    "duplicate_groups",
    "coerce_numeric",
    "numeric_summary",
    "breakdown_product",
    "breakdown_region",
    "chart_series_line",
    "analysis_report",
    "injection_check",
    "pii_redact",
    "sanitize_output",
    "route_intent",
    "mentioned_columns",
    "rate_limit",
    "validate_requests",
    "session_state",
    "trace_text",
    "load_messy_csv",
    "detect_delimiter",
    "x_outliers",
    "x_key_overlap",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="bench")
    for name in ("table_shape", "rate_limit"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
