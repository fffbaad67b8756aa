"""Headline queries timed on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is executed in full through the ``noop`` sink (every column computed, nothing
collected to the driver), once on the smallest tables to warm the JVM and the Python
workers, then timed on $BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = (
    "clean_strong",
    "clean_trace",
    "split_stratified_exact",
    "score_head",
    "predict_all_models",
    "compare_with_ensemble",
    "metrics_by_domain",
    "encode_ids",
    "head_gradient",
    "stream_predict",
    "read_posts_semicolon",
    "score_large_vocabulary",
    "fit_head",
    "fit_text_lr",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from botsift.session import local_session, scratch_scope
    from botsift.plans.catalog import QUERIES

    spark = local_session(cpus, "botsift-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    names = [q for q in HEADLINE if q in QUERIES]
    # warm-up on the smallest data set: JVM class loading, codegen, Python worker start-up
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for q in names:
        QUERIES[q](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for q in names:
        t0 = time.perf_counter()
        with scratch_scope(spark):                                        # intermediate tables go with the query
            QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[q] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
