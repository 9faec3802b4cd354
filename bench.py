"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.  Every query is run
cold once, then warm; the warm median counts.  Results go to a sink that
computes every column and keeps none.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import QUERIES  # noqa: E402
from webquarry.session import build_session  # noqa: E402

HEADLINE = (
    "host_overview", "page_links", "page_titles", "page_assets", "page_forms", "page_records",
    "canonical_urls", "emails", "secrets", "endpoints", "run_caps", "tech_fingerprint",
    "robots_allowed", "frontier_bfs", "known_links", "asset_outcomes", "ext_paths",
    "blocked_pages", "request_attempts", "host_gaps", "stream_links",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.webquarry.readPartitions": cpus,
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="webquarry-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm, cold = {}, {}
    for name in names:
        times = []
        for _ in range(1 + repeats):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        cold[name] = round(times[0], 3)
        warm[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": Path(sf).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
