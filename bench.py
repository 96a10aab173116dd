"""Time the headline queries and print one JSON line.

The graph tables are written first and timed on their own, as every analysis
reads them; each query is then run to completion without keeping its rows.
"""

from __future__ import annotations

import json
import os
import time

from loomgraph.plans.queries import all_queries
from loomgraph.plans.warehouse import Warehouse
from loomgraph.session import local_session

HEADLINE = [
    "g1_compose", "g2_dedup_edges", "g3_centrality", "g6_region_rollup", "g7_region_edges", "g8_call_pairs",
    "a1_communities", "a3_hops", "a5_blast_radius", "a5_blast_summary", "a6_call_layers", "a8_import_cycles", "a10_workflow_expand",
    "k3_removal_impact", "k5_options", "p2_understood", "p8_progress_stream",
    "l3_concept_chart", "l4_project_overview", "l7_community_groups", "l11_name_rank",
    "s2_ignore_filter", "s7_decode_lines", "f1_py_defs", "r1_py_import", "c4_py_calls", "c6_go_calls",
    "t1_neighbors", "t4_structural_summary", "t7_ground_responses",
]
# Tables the queries read; writing them is the build of the graph.
GRAPH_TABLES = ["nodes", "raw_imports", "raw_calls", "imports", "calls", "outline", "concepts", "files", "central", "homes", "regions", "region_edges"]
# Derived inputs of later queries, written outside the timings of those.
INPUT_TABLES = ["signatures", "events", "understood", "visited", "claims", "communities", "hops", "documents", "sources", "facts",
                "neighbors", "lens"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    catalogue, timings = all_queries(), {}
    warehouse = Warehouse(spark, folder)

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        timings[name] = round(time.perf_counter() - start, 3)

    timed("graph_build", lambda: [getattr(warehouse, name) for name in GRAPH_TABLES])
    timed("inputs_build", lambda: [getattr(warehouse, name) for name in INPUT_TABLES])
    for name in HEADLINE:
        timed(name, lambda: catalogue[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
