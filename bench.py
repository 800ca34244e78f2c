"""Time the headline queries at ``$BENCH_SF_DIR`` and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ("voxel_histogram", "typed_total_rollup", "agfe_raw", "agfe_smoothed", "accessible_mask", "merge_median",
            "merge_coverage", "cc_labels_26", "hotspots", "field_descriptors", "site_rank", "watershed_hotspots",
            "zone_occupancy", "survival_curve", "contacts", "rmsf_residue", "rdf", "stream_histogram")


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from voxelloom.plans.catalog import QUERIES
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(root.rstrip("/"))}))


if __name__ == "__main__":
    main()
