"""Per-query job/stage/task counts and executor time from Spark's event log.

Usage: python tools/stage_times.py [sf_dir] [name ...]

The event log goes to a fresh scratch folder (no UI, no server); each query is
run once to warm up and once measured into the ``noop`` sink, inside its own
job group, and the log is summarised per group.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridseries.plans import registry as R  # noqa: E402
from gridseries.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["mosaic_sum", "mosaic_mean", "prune_parts", "mosaic_sum_ship"]
    log_dir = tempfile.mkdtemp(prefix="gridseries-eventlog-", dir="/tmp")
    spark = build_session("local[8]", extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                                 "spark.eventLog.compress": "false"})
    sc = spark.sparkContext
    wall = {}
    for name in names:
        sc.setJobGroup("warmup", "warmup")
        R.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        sc.setJobGroup(name, name)
        t = time.perf_counter()
        R.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        wall[name] = time.perf_counter() - t
    sc.setJobGroup("done", "done")
    spark.stop()
    job_group, stage_job, stats = {}, {}, {}
    files = glob.glob(f"{log_dir}/**/events_*", recursive=True) or glob.glob(f"{log_dir}/*")
    for path in sorted(p for p in files if os.path.isfile(p)):
        with open(path) as fh:
            for line in fh:
                e = json.loads(line)
                ev = e.get("Event")
                if ev == "SparkListenerJobStart":
                    g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    job_group[e["Job ID"]] = g
                    for sid in e.get("Stage IDs", []):
                        stage_job[sid] = e["Job ID"]
                elif ev == "SparkListenerTaskEnd":
                    g = job_group.get(stage_job.get(e["Stage ID"]))
                    if g in wall:
                        m = e.get("Task Metrics") or {}
                        s = stats.setdefault(g, {"stages": set(), "tasks": 0, "run_ms": 0})
                        s["stages"].add(e["Stage ID"])
                        s["tasks"] += 1
                        s["run_ms"] += m.get("Executor Run Time", 0)
    jobs = {}
    for j, g in job_group.items():
        jobs[g] = jobs.get(g, 0) + 1
    for name in names:
        s = stats.get(name, {"stages": set(), "tasks": 0, "run_ms": 0})
        print(f"{name:24s} wall {wall[name]:6.2f}s  jobs {jobs.get(name, 0):2d}  stages {len(s['stages']):2d}  "
              f"tasks {s['tasks']:4d}  executor run {s['run_ms'] / 1000:6.2f}s")
    print(f"event log: {log_dir}")


if __name__ == "__main__":
    main()
