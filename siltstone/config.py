"""Settings, with the constants that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # chunks and blocks, in estimated tokens
    block_level: int = 2
    chunk_max: int = 384
    chunk_min: int = 128
    block_max: int = 2000
    block_min: int = 100
    shell_title_max: int = 30
    shell_lines_max: int = 3
    numbered_item_min: int = 50
    image_run_min: int = 3
    heading_cap: int = 5
    title_chars: int = 60
    # retrieval
    top_k: int = 12
    per_role_k_min: int = 8
    rrf_k: int = 60
    dense_weight: float = 0.4
    bm25_weight: float = 0.6
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    promoted_block_max: int = 2000
    context_budget: int = 10000
    strip_repeated_heading: bool = False
    # roles; the order decides ties
    roles: tuple[str, ...] = ("sop", "emergency", "regulation", "directory", "knowledge", "equipment", "reagent", "notice", "junk")
    keyword_cap: int = 3
    heading_factor: int = 2
    low_margin: int = 3
    junk_bonus: int = 20
    similarity_min: float = 0.6
    router_confidence: float = 0.95


DEFAULT = Settings()
