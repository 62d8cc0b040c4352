"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) choose data and cores. Every query runs to its
last row into a sink that keeps nothing.
"""

import json
import os
import sys
import time

from folioscope.plans.registered import QUERIES
from folioscope.session import build_session

HEADLINE = (
    "r01_hybrid_search", "r02_exact_knn", "r04_bm25_lines", "r05_keyword_only", "r16_admissibility", "r17_excerpt",
    "f24_stale_marker", "f46_extractive_snapshot", "q01_open_claims", "q02_index_currency", "s04_change_classes",
    "a02_inbound_links", "g02_promotion_gate", "g04_retraction_cascade", "a03_rule_idf", "g05_near_duplicate_groups",
    "h01_idempotent_capture", "h06_name_resolution", "w07_chunk_packing", "w12_request_limiter", "r12_pair_rerank", "a18_ranking_ab",
    "g03_promote", "x01_stream_corpus", "x02_stream_capture", "z02_dedup_verdict", "g05_leader_clusters",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", max(int(cpus), 4), {"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["f01_basename_slug"](spark, sf_dir).limit(1).collect()  # start the JVM and the Python workers
    took = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
