"""Engine settings, checked once when they are built."""

from __future__ import annotations

from dataclasses import dataclass

from corpusq import fixed_values as fv


@dataclass(frozen=True)
class EngineConfig:
    """Semantics-bearing settings handed to the operators."""

    chunk_size: int = fv.CHUNK_SIZE
    chunk_overlap: int = fv.CHUNK_OVERLAP
    default_top_k: int = fv.DEFAULT_TOP_K
    max_top_k: int = fv.MAX_TOP_K
    rerank_enabled: bool = False
    rerank_top_n: int = fv.RERANK_TOP_N
    hybrid_enabled: bool = False
    bm25_weight: float = fv.BM25_WEIGHT
    max_messages: int = fv.MEMORY_MAX_MESSAGES
    session_ttl: int = fv.MEMORY_TTL_SECONDS
    default_user: str = fv.DEFAULT_USER
    isolation: str = "all"
    max_upload_mb: int = fv.MAX_UPLOAD_MB
    filter_mode: str = "pre"
    search: str = "exact"
    metric: str = "cosine"

    def __post_init__(self):
        checks = {
            "isolation": (self.isolation, ("all", "documents", "none")),
            "filter_mode": (self.filter_mode, ("pre", "post")),
            "search": (self.search, ("exact", "ann")),
            "metric": (self.metric, ("cosine", "dot", "l2")),
        }
        for name, (value, allowed) in checks.items():
            if value not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, got {value!r}")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and below chunk_size")
        if not 0.0 <= self.bm25_weight <= 1.0:
            raise ValueError("bm25_weight must lie in [0, 1]")
        for name in ("default_top_k", "max_top_k", "rerank_top_n", "max_messages",
                     "session_ttl", "max_upload_mb"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")

    @property
    def isolated(self) -> bool:
        """Owner filters apply for both isolating levels."""
        return self.isolation in ("all", "documents")

    @property
    def max_upload_bytes(self) -> int:
        return self.max_upload_mb * 1024 * 1024
