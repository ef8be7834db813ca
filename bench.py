"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs twice into a sink that drops the rows; the second time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans import catalog  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

HEADLINE = [
    "latest_by_key", "replacing_latest", "pair_start_end", "loading_state", "ztest_run", "ztest_view", "chk_uniq", "chk_cnt_delta", "table_fingerprint",
    "reconcile_counts", "table_diff", "exchange_increment", "infer_flow_schema", "next_window", "package_confirm", "plan_batch", "event_ready", "monitor_action",
    "calendar_deadlines", "workload_10min", "day_board", "delivery_failures", "failures_by_task", "failures_by_day", "wait_causes", "retention_children", "populate_record",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tidewatch-bench")
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
