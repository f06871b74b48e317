"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from repotide.catalog import QUERIES
from repotide.session import build_session

HEADLINE = [
    "a01_file_inventory", "a04_jest_failures", "b04_repo_policies", "c02_imports", "c06_rule_scan", "c10_parse_audit",
    "d01_doc_ownership", "d07_longest_prefix", "d10_resolve_imports", "e01_build_graph", "e07_impact", "e11_propagation",
    "e13_components", "e21_affected_tests", "e25_task_waves", "f05_doc_freshness", "f02_module_coverage", "f11_effective_coverage",
    "f16_snapshot_trend", "f23_error_summary", "f29_eta", "f36_kpi", "g06_stable_numbering", "j02_status_counts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("repotide-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").count()  # start the engine
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
