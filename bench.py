"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "hist_class_norm", "a4_head_fanout", "a2_heatmap", "a3_head_stats", "w12_abs_zscore", "w7_attribution", "w6_bh_fdr", "m5_spearman", "m6_welch", "m23_eval_binary",
    "m2_neighbours_topk", "j6_neighbour_arrays", "m8_same_label_enrichment", "a24_retrieval", "m11_permutation_null", "j10_band", "j1_inner_left", "p5_point_lookup", "p6_locus_range", "p7_search", "f2_bands", "m9_bootstrap_ci", "t1_state_machine",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from varistra.plans import catalog, storage_queries
    from varistra.session import local_session

    spark = local_session("varistra-bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["hist_class_norm"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    storage_queries.prepare(catalog.Tables(spark, sf_dir))  # p5, p6 and p7 ask tables that a service has indexed beforehand
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
