"""Headline queries, timed. Prints one JSON line; reads BENCH_SF_DIR and BENCH_CPUS.

Each query is run twice and the second run is reported, as in a session that stays up; ``first_run`` has the first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

# The plan-check filters, then one change set, its apply, its undo, and the log and discovery
# reports around them.
HEADLINE = (
    "filter_price_between",
    "filter_status_eq",
    "filter_sku_contains",
    "filter_category_in",
    "filter_color_in",
    "filter_meta_eq",
    "filter_meta_gt",
    "filter_price_variation",
    "filter_category_inherited",
    "filter_variation_size_in",
    "filter_and_combined",
    "filter_or_mixed",
    "preview_formula",
    "product_page",
    "changeset_formula",
    "changeset_two_actions",
    "catalog_after_apply",
    "meta_after_apply",
    "undo_changeset_skip",
    "audit_page",
    "operation_summary",
    "operation_progress",
    "completion_report",
    "retention_survivors",
    "discover_categories",
    "discover_meta_keys",
    "advance_rules",
    "stream_enforcement",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from shelfwright.plans.registry import QUERIES

    names = sys.argv[1:] or HEADLINE
    first: dict[str, float] = {}
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
            first.setdefault(name, seconds[name])
    total = round(sum(seconds.values()), 3)
    # Change rows per second, to set beside stated write rates.
    rates = {
        name: round(QUERIES[name](spark, path).count() / seconds[name])
        for name in ("changeset_formula", "undo_changeset_skip")
        if name in seconds
    }
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "first_run": first, "rows_per_sec": rates, "sf": path.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
