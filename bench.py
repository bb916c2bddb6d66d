"""Time the headline queries: ``BENCH_SF_DIR`` (data), ``BENCH_CPUS`` (local cores). Prints one JSON line.

Tables that land as one file are landed again in small row groups first (``sources.pages.land``), as a crawl would write
them. Each query runs twice; the second, warm run counts, and what building and planning it took is told apart.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from quire import catalog  # noqa: E402
from quire.sources.pages import land  # noqa: E402

HEADLINE = (
    "T1_tokens", "T2_stripped_text", "T13_titles", "L5_first_links", "L8_dates_near_links", "D1_parsed_dates",
    "D2_page_dates", "B1_without_navigation", "B4_main_region", "B6_list_links", "P2_P9_kept_paragraphs",
    "P11_plain_text_blocks", "C3_chapters", "C7_reading_order_newest_first", "C7_reading_order_by_ranges",
    "C9_table_of_contents", "I7_collection_images", "M1_upsert", "M2_marked_read", "M9_title_matches",
    "M14_listing_lines", "N1_missing_and_merged", "N2_rebuild", "E1_region_paragraphs", "E1_extracted_content",
)
LANDED = ("pages", "documents", "orders")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times, planning = catalog.all_queries(), {}, {}
    data = tempfile.mkdtemp(prefix="bench-")
    for name in os.listdir(sf_dir):
        if name.split(".")[0] in LANDED:
            land(spark.read.parquet(f"{sf_dir}/{name}"), f"{data}/{name}", 2 * spark.sparkContext.defaultParallelism, 1 << 20)
        else:
            os.symlink(f"{sf_dir}/{name}", f"{data}/{name}")
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            df = queries[name](spark, data)
            df._jdf.queryExecution().executedPlan()
            planning[name] = round(time.perf_counter() - start, 3)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": times,
             "planning": planning, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
