"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from placebook.plans import catalog_queries, file_queries, order_queries, table_queries  # noqa: F401
from placebook.plans.registry import QUERIES
from placebook.session import build_session

HEADLINE = [
    "consensus_postal",
    "consensus_admin",
    "distinct_combinations",
    "group_profile",
    "level_profile",
    "sample_rows",
    "search_rows",
    "search_via_source",
    "integrity_audit",
    "source_profile",
    "stored_view_counts",
    "catalog_entries",
    "catalog_build",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # The data is small: let eight threads share it.
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.environ.get("BENCH_WARM_DIR", f"{os.path.dirname(folder.rstrip('/'))}/sf0.001")
    if os.path.isdir(small):
        # Class loading and code generation happen here; the data is not touched.
        for name in names:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    result = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
