"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the number of local threads.  A time covers building the plan, the
intermediate tables a query writes, and the full result.
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lorebase.plans import REGISTRY  # noqa: E402
from lorebase.sources.scratch import release  # noqa: E402

HEADLINE = [
    "search_catalog", "search_catalog_english", "search_documents", "search_catalog_text_only",
    "text_rank", "vector_candidates", "vector_candidates_approximate",
    "retrieval_eval_text", "retrieval_eval_hybrid", "retrieval_health", "memory_usage",
    "embedding_health", "embedding_vectors", "embedding_applied", "catalog_coverage",
    "catalog_seed", "catalog_snapshot_diff", "catalog_mark_stale", "catalog_apply_change_log", "catalog_change_stream",
    "task_dashboard", "actionable_tasks", "tasks_by_owner", "startup_summary",
    "runs_drift", "runs_active_failures", "runs_readiness", "runs_compliance_trend", "runs_cross_factory",
    "rules_by_agent", "agreement_status", "retired_terms_in_knowledge", "dead_references",
    "connector_readiness_by_session", "quality_uniqueness", "quality_references",
    "profile_signatures", "profile_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lorebase-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["search_catalog"].run(spark, sf_dir).limit(1).collect()  # start JVM and Python workers

    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
