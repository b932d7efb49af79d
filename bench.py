"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "prj9_fusion_features", "ag1_attack_gallery", "ag2_live_stats", "ag10_auc_lineitem", "ag13_per_detector", "ag21_cost_curve", "ag27_distribution",
    "cal9_fit_policy_thresholds", "fe1_keystroke_features", "fe5_behavioral_rules", "sc1_find_pan", "sc12_metadata_rules", "sc22_heuristic_fuse", "wn4_reason_rank",
    "jn4_face_links", "jn5_asset_links_exact", "jn7_best_asset_links", "cal5_impostor_summary", "gr1_connected_components", "gr2_threat_graph_rings",
    "sc23_final_score", "flagship_ring_decisions", "st5_attack_wave",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from fraudloom.plans import catalogue

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("fraudloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()  # JVM warm-up
    times = {}
    for name in wanted:
        runs = []
        for _ in range(2):  # the lower of two, so that compilation and the machine show less
            start = time.time()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
