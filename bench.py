"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from vertexloom.plans import catalogue

HEADLINE = [
    "cell_density", "curve_keys", "curve_round_trip", "route_keys", "neighbor_counts", "neighbor_values", "distances_to_one", "box_query",
    "ring_density", "rollup_one", "occupancy_layer", "temporal_layer", "tsdf_layer", "gradients", "mesh_points", "frontier_cells",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "8m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run = catalogue.queries()[name]
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.time()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
