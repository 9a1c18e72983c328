"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from casemill.plans import catalog
from casemill.session import build_session

HEADLINE = [
    "e5_system_measure",
    "e1_average_precision",
    "e4_metric_block",
    "e8_model_table",
    "d1_temporal_split",
    "d2_stratified_split",
    "d6_shift",
    "d13_bootstrap_ap",
    "k1_select_cases",
    "a1_batch_summary",
    "a9_ecdf",
    "a10_five_numbers",
    "t10_forbidden",
    "t13_audit",
    "t6_verdicts",
    "t2_batch_dossier",
    "m5_linear_contrib",
    "h2_wilcoxon",
    "x2_window_cases",
    "x4_latency",
    "x5_occupancy",
    "x2s_window_cases",
    "m2_random_forest",
    "m4_trained_triage",
    "d11_smote",
    "d7_shift_table",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "casemill-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    first, warm = {}, {}
    for name in wanted:
        for times in (first, warm):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the headline queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "first_run": first,
                "events_per_sec": {q: round(events / max(s, 1e-3)) for q, s in warm.items()},
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
