"""Settings that define results. Passed explicitly; never kept in the session."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_size: int = 512  # words
    chunk_overlap: int = 64
    min_words: int = 20
    top_k: int = 8  # candidates of each arm
    final_k: int = 5
    exact_search_max: int = 80_000
    min_relevance: float = 0.35
    rerank: bool = False
    rerank_top_n: int = 20
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    tokenizer_version: str = "2-snowball-stopword-punct"

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
        if self.final_k > 2 * self.top_k:
            raise ValueError("final_k cannot exceed what two arms can give")
