"""Headline timings: one JSON line, seconds per query on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from citeloom.plans import load  # noqa: E402
from citeloom.session import local_session  # noqa: E402

HEADLINE = (
    "tokenize_distinct",
    "bm25_course_stats",
    "bm25_topk",
    "bm25_scoped_topk",
    "vector_topk_by_tenant",
    "rrf_fuse",
    "hybrid_retrieve",
    "hybrid_scoped_retrieve",
    "distinct_passages",
    "chapter_rollup",
    "chunk_line_packing",
    "chunk_overlap_lag",
    "header_asof_chunk",
    "list_window_range",
    "formula_completion",
    "list_completion",
    "structured_chunks",
    "version_argmax",
    "scd2_promote",
    "evidence_metadata",
    "paper_totals_left_join",
    "blueprint_fill",
    "recommendations_top5",
    "eval_by_course",
    "intent_context_inherit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    queries = load().queries
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times: dict[str, float] = {}
    for name in list(queries) if names == ["all"] else names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
