"""Time the headline queries on local[$BENCH_CPUS] and print one JSON line.

Questions are asked of a corpus that was ingested before, so the time to build
the stored snapshot is its own entry (``build_store``) and the retrieval
entries read that snapshot. Every entry computes its whole result.
"""

from __future__ import annotations

import json
import os
import time

from corpusloom.plans import retrieval
from corpusloom.plans.catalog import QUERIES
from corpusloom.session import local_session

HEADLINE = (
    "document_metadata",
    "chunk_headers",
    "tokenize_corpus",
    "embed_chunks",
    "bm25_corpus_stats",
    "bm25_search",
    "cosine_topk",
    "cosine_topk_chunks",
    "graph_search",
    "graph_to_chunks",
    "rrf_fuse",
    "hybrid_retrieve",
    "fit_context",
    "audit_answers",
    "recall_at_k",
    "edge_dedup",
    "apply_status_updates",
    "knowledge_base_status",
    "generation_summary",
    "stage_histogram",
    "stream_stage_metrics",
    "stream_assemble_answers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}

    start = time.perf_counter()
    store = retrieval.store(spark, sf_dir).whole()
    times["build_store"] = round(time.perf_counter() - start, 3)
    chunks = store.chunks.count()
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count() * 20

    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                "chunks": chunks,
                "chunks_per_sec_ingest": round(chunks / times["build_store"], 1),
                "questions": asked,
                "ms_per_question_hybrid": round(1000 * times["hybrid_retrieve"] / asked, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
