"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (every row is
computed, nothing is collected to the driver).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "popular_categories", "enrich_interactions", "system_stats", "user_profiles", "features",
    "covisitation_edges", "sessionize", "similar_items", "recent_interactions", "recommend_control",
    "candidates", "text_search", "literal_search", "vector_search", "content_similar", "tfidf_vectors",
    "classify_intent", "ab_significance", "bandit_stats", "stream_sessions", "stream_experiment_metrics",
    "dedup_articles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from rivulet.plans.registry import load_all
    from rivulet.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="rivulet-bench",
                          checkpoint=tempfile.mkdtemp(prefix="rivulet-bench-ckpt-"))
    reg = load_all()
    # warm-up: JVM, Python workers and file listing
    reg["items_by_type"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
