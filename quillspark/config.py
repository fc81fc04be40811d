"""Options of the engine and their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    chunk_strategy: str = "page_aware"
    chunk_size: int = 1200
    chunk_overlap: int = 200
    top_k: int = 8
    candidate_multiplier: int = 15
    retrieval_mode: str = "hybrid"
    fusion: str = "rrf"
    rrf_k: int = 60
    min_score: float = 0.0
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    semantic_weight: float = 0.7
    bm25_weight: float = 0.3
    rerank_semantic_weight: float = 0.3
    rerank_lexical_weight: float = 0.7
    similarity_threshold: float = 0.55
    enable_rerank: bool = True
    enable_spelling: bool = True
    spelling_min_confidence: float = 0.85
    enable_booster: bool = True
    booster_min_words: int = 6
    embedding_dims: int = 1024
    max_bytes: int = 50 << 20
    max_pages: int = 120
    page_chars: int = 3500
    summary_chars: int = 48_000
    knowledge_collection: str = "knowledge"
    text_engine: str = "digital"

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap <= self.chunk_size // 2:
            raise ValueError("chunk_overlap must lie between 0 and half of chunk_size")
        if self.fusion not in ("rrf", "weighted"):
            raise ValueError(f"unknown fusion: {self.fusion}")
        if self.text_engine.lower() not in ("digital", "digital_text", "none", ""):
            raise ValueError(f"unknown text engine: {self.text_engine}; only text layers are read")
        if self.chunk_strategy not in ("recursive", "page_aware", "layout_aware", "semantic"):
            raise ValueError(f"unknown chunk strategy: {self.chunk_strategy}")


def from_env(prefix: str = "QUILL_", env: dict | None = None) -> Options:
    """Options from the environment; a value that cannot be read falls back to its default."""
    env = os.environ if env is None else env
    found = {}
    for f in fields(Options):
        raw = (env.get(prefix + f.name.upper()) or "").strip()
        if not raw:
            continue
        kind = type(f.default)
        try:
            found[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        except ValueError:
            continue
    return Options(**found)
