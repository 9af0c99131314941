"""Defaults of the retrieval and ingestion jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Defaults that decide results."""

    min_chars_per_page: int = 40
    min_extraction_ratio: float = 0.20
    chunk_chars: int = 1900
    overlap_chars: int = 285
    candidates: int = 12
    context_chunks: int = 4
    min_relevance: float = 0.45
    lexical_override: float = 0.5
    rrf_k: int = 60
    dedup_similarity: float = 0.90
    adjacent_similarity: float = 0.50
    rerank_candidates: int = 20
    context_tokens: int = 4096
    answer_tokens: int = 450
    system_chars: int = 3000  # length of the instructions sent with every question
    prompt_overhead: int = 80
    budget_margin: float = 0.05
    min_first_block: int = 256
    chars_per_token: float = 3.3
    graph_pages: int = 3
    head_chars: int = 6000
    graph_edges: int = 8
    graph_score: float = 0.5
    max_retries: int = 2
    borderline_margin: float = 0.10
    quota_bytes: int = 2048 * 1024 * 1024
    k1: float = 1.5
    b: float = 0.75


DEFAULTS = Options()
