"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
"""

from __future__ import annotations

import json
import os
import time

from panelstat import registry
from panelstat.session import local_session

HEADLINES = [
    "pair_screen",
    "cohort_report",
    "cohort_family",
    "value_shares",
    "resistance_table",
    "yearly_global_top",
    "tested_outcome_long",
    "transaction_items",
    "routine_policy",
    "escalation_score",
    "pair_effects",
    "screened_effects",
    "shrinkage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="bench")
    entries = registry.load()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start-up is not part of any query
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        entries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
