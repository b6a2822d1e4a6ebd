"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import re
import sys
import time

from strata.checks import QUERIES
from strata.session import build

# One or two per operator family: ids, dedup, resolution, upserts, order, spans, markup, code, graph, streams.
HEADLINE = [
    "entity_id_customers", "dedup_first_calls", "dedup_last_orders", "call_edges_cross_nation", "merge_passes",
    "upsert_nodes_two_batches", "upsert_edges_patch", "instance_ids_lineitem", "carry_forward_events",
    "enclosing_spans_events", "doc_line_counts", "complexity_docs", "markup_elements", "markup_attributes",
    "go_nodes", "java_nodes", "python_nodes", "ts_calls", "sql_references", "pattern_region_orders", "reach_region",
    "impact_supplier", "edge_schema", "similar_profiles", "stream_upsert_events",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build("strata-bench", cores, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
                                            "spark.ui.showConsoleProgress": "false"})
    QUERIES["entity_id_customers"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)", sf)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
