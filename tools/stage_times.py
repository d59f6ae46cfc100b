"""Summarise a Spark event log: the slowest stages and per-job totals.

    BENCH_EVENT_LOG_DIR=$(mktemp -d /tmp/run-XXXXXX) python bench.py host_features
    python tools/stage_times.py <that folder> [top]

Reads plain or zstd-compressed event files (rolling ``eventlog_v2_*``
folders included); no UI or REST endpoint is involved.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    if path.endswith(".zstd") or path.endswith(".zst"):
        import zstandard

        with open(path, "rb") as fh:
            data = zstandard.ZstdDecompressor().stream_reader(fh).read()
        yield from io.StringIO(data.decode("utf-8"))
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def _files(root: str) -> list[str]:
    if os.path.isfile(root):
        return [root]
    found = sorted(glob.glob(os.path.join(root, "**", "events_*"), recursive=True))
    found += sorted(p for p in glob.glob(os.path.join(root, "*")) if os.path.isfile(p))
    return found


def summarise(root: str, top: int = 15) -> None:
    stages, jobs = {}, {}
    for f in _files(root):
        for line in _lines(f):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerStageCompleted":
                si = ev["Stage Info"]
                dur = si.get("Completion Time", 0) - si.get("Submission Time", 0)
                stages[si["Stage ID"]] = (dur, si["Number of Tasks"], si["Stage Name"][:80])
            elif kind == "SparkListenerJobStart":
                jobs[ev["Job ID"]] = [ev["Submission Time"], None]
            elif kind == "SparkListenerJobEnd" and ev["Job ID"] in jobs:
                jobs[ev["Job ID"]][1] = ev["Completion Time"]
    done = [(b - a) for a, b in jobs.values() if b]
    print(f"jobs={len(jobs)} job_ms={sum(done)} stages={len(stages)}")
    for sid, (dur, tasks, name) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]:
        print(f"stage {sid:5d} {dur:7d} ms {tasks:6d} tasks  {name}")


if __name__ == "__main__":
    summarise(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 15)
