"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from seqledger.plans import QUERIES
from seqledger.session import local_session

HEADLINE = (
    "files_deliverable",
    "metrics_project",
    "samples_pair",
    "file_related_ids",
    "operation_readset_ids",
    "duplicate_metrics",
    "relinked_job_metrics",
    "deduplicated_readset_files",
    "deduplicated_files",
    "rescue_strict_links",
    "rescue_loose_links",
    "jobs_without_orphans",
    "deduplicated_job_metrics",
    "deduplicated_metric_links",
    "metric_rollup",
    "digest_readset_file",
    "digest_pair_file",
    "unanalyzed_sample_names",
    "delivery_nested_files",
    "delete_cascade_up",
    "curated_specimens",
    "ingested_files",
    "pipeline_metric_versions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["projects_all"](spark, folder).collect()
    QUERIES["files_deliverable"](spark, folder).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        # Every row and column is computed, none is brought to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
