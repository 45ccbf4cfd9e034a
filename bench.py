"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Each query runs once to warm up and once for the record, into a sink that
computes every column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import queries as registered  # noqa: E402
from wiretally.session import local_session  # noqa: E402

HEADLINE = ["b10_conjunction", "c1_pattern_alerts", "c2_rate_alerts", "c3_distinct_ports", "c4_distinct_hosts", "c5_all_rules",
            "d_offline_alerts", "e1_cooldown", "f11_top_attackers", "f12_minute_timeline"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    q = registered.queries()
    packets = registered.packets(spark, sf_dir).count()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.time()
            q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "packets": packets,
        "offline_packets_per_sec": round(packets / seconds["d_offline_alerts"])}))
    spark.stop()


if __name__ == "__main__":
    main()
