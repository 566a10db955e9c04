"""Settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    embedding_dim: int = 4096
    embedding_batch: int = 32
    embed_chars: int = 7000
    rerank_chars: int = 5000
    rerank_candidates: int = 50
    chunk_size: int = 1000
    chunk_overlap: int = 150
    long_chunk_size: int = 4800
    long_chunk_overlap: int = 600
    min_chunk_chars: int = 30
    top_k: int = 24
    max_per_doc: int = 4
    min_score: int = 6
    evidence_n: int = 10
    batch_limit: int = 30
    split_pages: int = 180
    page_budget: int = 2000
    figures_per_section: int = 2
    figure_min_score: float = 0.2
    min_text_chars: int = 200
    head_chars: int = 3000
    section_chars: int = 40_000


DEFAULT = Config()
