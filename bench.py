"""Bench: headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is executed in full with the ``noop`` sink (no collect to the driver).  The value is
the sum of per-query wall seconds (best of ``BENCH_REPEAT`` runs, default 1).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradebook.plans.catalog import load_all  # noqa: E402
from gradebook.session import local_session  # noqa: E402

HEADLINE = [
    "accuracy_table", "response_distribution_rep", "plurality_vote", "consistency", "kappa_matrix",
    "wilcoxon_signed_rank", "boot_mean_consistency", "article_metadata", "article_sections",
    "global_agreement", "dominance", "clean_xrefs", "permuted_consistency",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="gradebook-bench")
    reg = load_all()
    # warm-up on the smallest tables so JVM start-up and JIT are not charged to the first query
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in ("accuracy_table", "plurality_vote"):
            reg[name].run(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.time()
            reg[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.time() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
