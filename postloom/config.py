"""Tunable values with their defaults; time is always a parameter."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    similarity_threshold: float = 0.72
    embedding_backend: str = "hashing"
    window_hours: float = 72.0
    weight_embedding: float = 0.60
    weight_entities: float = 0.20
    weight_keywords: float = 0.10
    weight_time: float = 0.10
    theme_bonus: float = 0.04
    embedding_dim: int = 384
    near_jaccard: float = 0.30
    near_jaccard_shared: float = 0.22
    near_containment: float = 0.72
    near_removal: float = 0.12
    rank_weights: tuple[float, ...] = (0.35, 0.20, 0.15, 0.10, 0.10, 0.10)
    secondary: float = 0.38
    edge_strong: float = 0.30
    edge_least: float = 0.05
    retention_days: int = 31
    queue_batch: int = 30
    now: str = "2024-01-31 00:00:00"

    @property
    def cluster_threshold(self) -> float:
        """From which similarity on posts are one event: hashed vectors are noisier, so with them the bar is 0.52 at most."""
        return min(self.similarity_threshold, 0.52) if "hash" in self.embedding_backend.lower() else self.similarity_threshold


DEFAULT = EngineConfig()
