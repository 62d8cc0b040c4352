"""Settings whose defaults change answers. Pass a changed copy, never mutate."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    chunk_tokens: int = 512
    chunk_overlap: int = 64
    contextual_prefix: bool = False
    rrf_k: int = 60
    priority_boost: float = 1.3
    link_step: float = 0.05
    link_cap: int = 5
    supersede_aware: bool = True
    supersede_penalty: float = 0.25
    recency_half_life_days: float = 120.0
    recency_amplitude: float = 0.15
    abstraction_topk_cap: int = 2
    abstraction_recency_guard: bool = True
    near_threshold: float = 0.28
    specific_threshold: float = 0.5
    gate_min_near: int = 3
    gate_density: float = 0.5
    serve_chunk_chars: int = 700
    budget_chars: int = 6000
    preview_chars: int = 360
    gate_min_chars: int = 3
    gate_min_content_words: int = 1
    cluster_threshold: float = 0.92
    cluster_max_size: int = 20
    rule_floor: float = 0.30
    rule_cap: int = 5
    belief_max_depth: int = 3
    prune_max_fraction: float = 0.5
    rerank_head: int = 30
    snapshot_ratio: float = 0.25
    snapshot_floor: int = 200
    commit_threshold: float = 0.5
    limit_requests: int = 120
    limit_seconds: int = 60

    def over_fetch(self, k):
        """Candidate depth per list. Deeper when a later cap may drop rows."""
        depth = max(4 * k, 40)
        return depth * 2 if self.abstraction_topk_cap >= 0 else depth


DEFAULTS = Params()

# Requests are answered in blocks of this many: one block is held by the driver and by every task at a time.
REQUEST_BLOCK = 2048
