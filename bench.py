"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the threads."""

from __future__ import annotations

import json
import os
import time

from docsail.queries import Q
from docsail.session import local_session

HEADLINE = [
    "term_bm25_top10", "match_multi_bm25", "bool_filter", "all_matches", "token_counts", "keyword_term", "long_range", "datetime_range", "wildcard", "fuzzy2",
    "sort_multi_key", "knn_cosine", "knn_filtered", "hybrid_knn_bool", "fetch_ids", "upsert_lww", "delete_filter", "consistent_overlay",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the second run doesn't count the compiling of code
            began = time.time()
            Q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
