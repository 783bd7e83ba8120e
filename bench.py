"""Times the headline graph queries: one JSON line, seconds per query."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from graphlens.plans import catalog

HEADLINE = (
    "graph_summary", "audit_security_boundaries", "resilience_gaps", "architecture_rules", "dependency_cycles",
    "architectural_health", "blast_radius", "transaction_scope", "data_flow", "search_architecture",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    began = time.time()
    catalog.stored(spark, folder)
    times = {"store_graph": round(time.time() - began, 3)}
    every = catalog.queries()
    for name in HEADLINE:
        began = time.time()
        every[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "graph_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
