"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_QUERIES may hold a comma-separated list of other names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from noteworks.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "match_concepts", "concept_counts_by_language", "detect_concepts", "clean_text", "redact_personal", "audit_summary",
    "rake_phrases", "tfidf_terms", "domain_scan", "top_concepts", "heatmap", "radar", "segment_distribution", "client_tags",
    "client_vector_mean", "similar_vectors_topk", "dbscan_components", "client_scores", "recommend_actions", "match_event_clients",
    "activation_by_event", "kpi_counts", "assign_round_robin", "client_360", "similar_in_segment", "collaborative_topk",
    "incremental_diff", "upsert_clients", "gdpr_erase_counts", "cooccurrence_pairs", "stat_features_elite", "graph_edges",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("noteworks-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(2):  # the first run also compiles; the better one counts
            begin = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(min(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
