"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from netquarry.queries import queries
from netquarry.session import session

HEADLINE = ("timeline", "engine_totals", "summary_stats", "flow_table", "app_distribution", "packet_details", "graph_nodes", "graph_edges", "report_actions", "payload_inspection", "tls_sni", "dns_queries", "top_domains", "worker_load", "parse_outcomes")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    known, took = queries(), {}
    known["parse_outcomes"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the workers
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
