"""Headline queries, each computed in full into a sink that keeps nothing.

Every query first runs on the smallest tables beside the given ones, so that
code is compiled and workers are up; then it is timed once.  Prints one JSON
line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import catalog  # noqa: E402

HEADLINES = (
    "to_blocks_long", "chunk_text", "batch_requests_events", "pending", "restore_order",
    "lookup_exact_hits", "upsert_memory", "glossary", "glossary_hints", "resolve_attempts",
    "parse_terms", "candidate_pairs", "causal_postings", "tm_lists", "review_report",
    "score_pairs", "translate_lines", "translate_documents",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tmloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    small = Path(sf_dir).parent / "sf0.001"
    seconds = {}
    for name in HEADLINES:
        if small.is_dir():
            catalog.QUERIES[name](spark, str(small)).write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1]),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
