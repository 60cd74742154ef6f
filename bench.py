"""Time headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS choose data and cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera import queries as core

NAMES = ["bm25_topk", "term_statistics", "dense_topk", "hybrid_topk", "name_resolution", "import_resolution", "position_lookup", "fact_fusion", "bounded_neighbourhood", "snapshot_root", "artifact_invalidation", "debounced_requests"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        core.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
