"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioscope.plans.registry import catalog  # noqa: E402
from folioscope.session import build_session  # noqa: E402

HEADLINE = ("search_without_vectors", "hybrid_search", "keyword_search", "vector_search", "grep_lines", "section_pieces", "similar_pairs", "centroid_relevance",
            "graph_overview", "graph_hubs", "resolved_links", "broken_links", "quote_verification", "citation_gaps", "unseen_candidates", "fair_budget",
            "triage_state", "chain_issues", "host_conflicts", "line_rollup", "weekly_spend", "nearest_session", "session_excerpts", "conversion_findings",
            "repetition", "resolved_sources", "tag_index_counts", "bibliographic_items", "batch_summary", "decision_stream")


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="bench", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog()
    queries["triage_state"](spark, root).count()
    queries["section_pieces"](spark, root).limit(1).count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
