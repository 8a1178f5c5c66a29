"""Thresholds and limits, as one immutable set of defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    pool_match: float = 0.78
    ann_accept: float = 0.72
    ann_margin: float = 0.04
    rerank_top: int = 8
    rerank_lead: float = 0.1
    relevance_floor: float = 0.30
    fallback_floor: float = 0.12
    cluster: float = 0.72
    model_gate: float = 0.8
    weak_result: float = 0.4
    model_pages: int = 3
    targeted_urls: int = 2
    productive_pages: int = 3
    rich_pool: int = 40
    sparse_pool: int = 30
    merge_top: int = 3
    specs_urls: int = 4
    specs_score: int = 25
    max_sources: int = 5
    cache_ttl_s: int = 3600


DEFAULTS = EngineConfig()
