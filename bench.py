"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder (default sf0.1), ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ethersense.checks import QUERIES
from ethersense.session import configure, local_session
from fixtures.captures import write_captures

HEADLINE = [
    "feature_rows", "frame_filter", "label_multiclass_other", "capture_summary", "feature_rank",
    "presence_time_windows", "presence_frame_windows", "presence_multitarget", "presence_replay",
    "presence_changes", "calibration_sweep", "classification_metrics", "balance_down",
    "balance_up", "split_chronological", "decode_frames", "ingest_captures", "bag_weights",
    "score_rule_model", "train_hoeffding", "stream_time_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = configure(local_session(cpus=cpus, partitions=cpus))
    names = sys.argv[1:] or HEADLINE
    small = sf_dir.rsplit("/", 1)[0] + "/sf0.001"
    if os.path.isdir(small):  # start the JVM, the Python workers and the code cache
        QUERIES["presence_multitarget"](spark, small).collect()
    if "ingest_captures" in names:  # the captures are an input, not work of the query
        write_captures(spark, sf_dir)
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
