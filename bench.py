"""Times the headline queries once warm; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from palimpsa.plans import catalogue

HEADLINE = [
    "bitemporal_as_of", "current_versions", "timeline_events", "filter_ast_range", "scope_applicability",
    "qualified_relations", "source_support", "support_intervals", "as_of_decision", "dashboard_counts",
    "reclassify_groups", "relation_usage", "metadata_facets", "keyset_page", "lexical_rank", "bm25_topk",
    "cosine_topk", "rrf_hybrid", "bfs_hops", "class_closure", "attribute_conflicts", "chunk_fixed", "outbox_fold",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts: code is compiled and files are cached
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
