"""Time the headline queries: one warm-up, then the median of three runs each. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyline.catalog import CATALOG
from tallyline.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ["vorp_rank", "entity_period_panel", "lag_matrix", "consecutive_pairs", "as_of_view", "quantile_band", "cohort_weighted_z", "share_and_crowding", "range_join_weeks", "longest_run",
            "isolated_absences", "trend_flags", "absent_streak", "with_without", "trailing_10_baseline", "water_fill", "state_fold", "replace_window_merge", "ledger_first_last_seen", "snapshot_diff",
            "dedupe_within_7_days", "topk_hit_capture", "ndcg_at_50", "average_rank_spearman", "period_metrics", "kappa_grid", "wls_coefficients", "caliper_match", "fuzzy_match", "grouping_sets_win_share",
            "decile_bins", "tier_gaps", "session_runs"]


def main() -> None:
    spark = build_session("bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for i in range(RUNS + 1):
            start = time.perf_counter()
            CATALOG[name].run(spark, FOLDER).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": FOLDER.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
