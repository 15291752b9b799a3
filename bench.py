"""Times the registered queries; prints one JSON line.

Each query is planned and run in full into a sink that keeps nothing. ``BENCH_SF_DIR``,
``BENCH_CPUS`` and ``BENCH_QUERIES`` (comma-separated names) choose data, cores and queries.
"""

from __future__ import annotations

import json
import os
import time

from docnest.session import session
from workload.queries import QUERIES

HEADLINE = (
    "customer_documents", "embed_one_label", "embed_many_lineitem", "embed_levels_customer", "embed_junction_part",
    "embed_fan_in", "computed_count_orders", "computed_sum_lineitem", "subset_recent_orders", "outlier_events",
    "customer_patterns", "attribute_part", "approximation_types", "pattern_chain", "normalised_events", "profile_edges",
    "profile_columns", "migrate_sales", "write_parquet_round_trip", "report_migration",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session(
        "docnest-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["table_row_counts"](spark, folder).collect()  # start-up is not part of any query
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
