"""Time headline queries; prints one JSON line. BENCH_SF_DIR: the tables, BENCH_CPUS: local threads."""

from __future__ import annotations

import json
import os
import time

from lodestone import queries as core
from lodestone.session import local_session

HEADLINE = ("token_df", "bm25_topk", "dense_topk", "hybrid_query", "find_existing", "sliding_windows", "gap_windows", "graph_degrees", "khop_neighbors", "import_edges", "memory_recall", "debounce_sessions", "source_chunks", "source_imports", "reverse_ppr")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("token_df", "dense_topk"):  # the JVM and the Python workers are warm from here on
        core.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        core.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
