"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run once to warm up and then three times; the median is reported.  The whole result is
computed (a no-op sink), nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import registry  # noqa: E402
from pitchlake.session import local_session  # noqa: E402

HEADLINE = (
    "poisson_walk_forward",
    "dixon_coles_walk_forward",
    "elo_walk_forward",
    "market_alignment",
    "latest_as_of",
    "resolve_namesakes",
    "resolve_misspelt",
    "import_summary",
    "paired_bootstrap",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory=os.environ.get("BENCH_MEMORY", "12g"))
    timings: dict[str, float] = {}
    for name in HEADLINE:
        samples = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(samples[1:]), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name,
                "cpus": cpus,
                "runs": RUNS,
                "warm": True,
            }
        )
    )


if __name__ == "__main__":
    main()
