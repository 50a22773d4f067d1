"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
Each query runs twice into the no-op sink: ``cold`` holds the first times (with code
generation and worker start), ``queries`` the second.  ``rates`` adds pages or items
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from domweave.plans import catalogue  # noqa: E402
from domweave.session import configure  # noqa: E402

HEADLINE = [
    "tag_counts", "page_links", "catalog_items", "xpath_fields_fallback", "thread_posts", "page_types",
    "repeating_groups", "best_selectors", "stored_page_analysis", "catalog_analysis", "similar_elements", "smart_locators",
    "clean_text", "clean_html", "column_profile", "checked_items", "validation_stats", "duplicate_documents",
    "paging_takewhile", "request_counters", "job_checks", "fallback_pick", "field_profile", "stream_counters",
]
PAGES = {"tag_counts": "parse", "page_links": "parse_extract", "stored_page_analysis": "parse_analyse"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("domweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        started = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    cold = {name: round(run(name), 3) for name in HEADLINE}
    times = {name: round(run(name), 3) for name in HEADLINE}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    items = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    rates = {f"{label}_pages_per_sec": round(pages / times[name], 1) for name, label in PAGES.items()}
    rates["validate_items_per_sec"] = round(items / times["checked_items"], 1)
    print(
        json.dumps({
            "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "cold": cold, "rates": rates,
        })
    )
    spark.stop()


if __name__ == "__main__":
    main()
