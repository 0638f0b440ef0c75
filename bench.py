"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) is the data, ``BENCH_CPUS`` (default 8) the local cores, ``BENCH_RUNS``
the timed runs after one warm-up run. Every value is the median of its runs, in seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from inkfold.plans import catalog
from inkfold.session import INPUT_PARTITIONS, build_session

HEADLINE = [
    "subcategory_groups", "classify", "dedupe_by_url", "extract_text", "page_features", "article_features",
    "top_keywords", "word_budget", "extract_paragraphs", "with_pages", "with_cache", "resolve_enrichment",
    "newsletter", "contents", "atom_entries", "source_health", "weekly_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        INPUT_PARTITIONS: str(2 * int(cpus))})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
