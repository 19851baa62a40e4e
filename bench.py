"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the cores of the
local session, BENCH_RUNS the timed runs (default 3). Every query runs once to warm up; the
timed runs go over all queries in an order drawn anew, and the median counts. Jobs and
shuffled bytes are those of a query's last run. Rows are all computed."""

from __future__ import annotations

import glob
import json
import os
import random
import re
import sys
import tempfile
import time
from collections import Counter
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.datasets import STAR, table_set  # noqa: E402
from checks.registry import QUERIES  # noqa: E402
from subsumo import discover  # noqa: E402

HEADLINE = [
    "unary_inds",
    "unary_inds_keep_nulls",
    "unary_overlaps",
    "partial_inds_90",
    "overlap_histogram",
    "attribute_groups",
    "column_stats",
    "nary_inds_maximal",
    "nary_inds_with_nulls",
    "augmentation_rules",
    "csv_quoted_lines",
    "csv_files_unary_inds",
]


def logged(folder: str) -> tuple[Counter, Counter]:
    """Jobs and shuffled bytes by job group, from the event log."""
    jobs, shuffled, group = Counter(), Counter(), {}
    for path in glob.glob(f"{folder}/*"):
        with open(path) as lines:
            for event in map(json.loads, lines):
                if event["Event"] == "SparkListenerJobStart":
                    name = (event.get("Properties") or {}).get("spark.jobGroup.id")
                    jobs[name] += 1
                    group.update({stage: name for stage in event["Stage IDs"]})
                elif event["Event"] == "SparkListenerTaskEnd":
                    written = (event.get("Task Metrics") or {}).get("Shuffle Write Metrics", {})
                    shuffled[group.get(event["Stage ID"])] += written.get("Shuffle Bytes Written", 0)
    return jobs, shuffled


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", 3))
    folder = tempfile.mkdtemp(prefix="bench-")
    os.makedirs(f"{folder}/events")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{folder}/checkpoint")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", f"file://{folder}/events")
        .config("spark.eventLog.compress", "false")
        .config("spark.eventLog.rolling.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, group: str) -> float:
        spark.sparkContext.setJobGroup(group, name)
        started = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    for name in HEADLINE:
        run(name, "warm-up")
    times = {name: [] for name in HEADLINE}
    for turn in range(runs):
        for name in random.sample(HEADLINE, len(HEADLINE)):
            times[name].append(run(name, name if turn == runs - 1 else "timed"))
    seconds = {name: round(median(t), 3) for name, t in times.items()}
    spark.sparkContext.setJobGroup("levels", "levels")
    levels = [
        {"arity": s.arity, "candidates": s.candidates, "inds": s.inds, "seconds": round(s.seconds, 3)}
        for s in discover(table_set(spark, sf_dir, STAR).stored()).level_stats
    ]
    version = spark.version
    spark.stop()
    jobs, shuffled = logged(f"{folder}/events")
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total time of the headline dependency queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
                "levels": levels,
                "jobs": {name: jobs[name] for name in HEADLINE},
                "shuffled_mb": {name: round(shuffled[name] / 1e6, 2) for name in HEADLINE},
                "runs": runs,
                "cpus": cpus,
                "spark": version,
            }
        )
    )


if __name__ == "__main__":
    main()
