"""Tunable thresholds of the curriculum loop, turned into literals by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


# The defaults below are the published behaviour of the loop.
@dataclass(frozen=True)
class Params:
    # batch shape
    batch_size: int = 10
    wide_variety_fraction: float = 0.35
    max_length: int = 512

    # failure vault
    vault_size: int = 10
    vault_retire_loss: float = 0.35
    vault_entry_floor: float = 0.35
    vault_min_round_candidates: int = 3
    vault_min_usable: int = 3
    vault_refill_rounds: int = 3
    vault_refill_floor: float = 0.15
    max_recycle_count: int = 2
    recycle_cooldown: int = 1

    # recipe
    max_recycle_slots: int = 3
    hard_max_recycle_slots: int = 2
    hard_slots: int = 3
    default_tags: tuple[str, ...] = ()

    # learning pressure
    pressure_weights: dict[str, float] = field(
        default_factory=lambda: {
            "vault_starvation": 0.30,
            "easy_batch": 0.25,
            "validation_plateau": 0.25,
            "shape_gap": 0.20,
        }
    )
    pressure_threshold: float = 0.65
    pressure_min_round: int = 3
    pressure_window: int = 3
    pressure_min_hits: int = 2
    pressure_cooldown: int = 1
    starvation_usable_target: int = 3
    starvation_easy_loss: float = 0.35
    easy_avg_loss: float = 0.18
    easy_p75_loss: float = 0.35
    easy_max_loss: float = 0.50
    shape_min_confidence: float = 0.50
    shape_low_share: float = 0.15

    # validation weakness
    weakness_base: float = 0.30
    weakness_degraded: float = 0.20
    weakness_slight: float = 0.35
    weakness_improving: float = 0.45
    weakness_plateau: float = 0.50
    weakness_min_slots: int = 1
    weakness_max_slots: int = 4
    weakness_improvement_delta: float = 0.03
    weakness_categories: int = 3

    # round health
    health_min_delta: float = 0.03
    health_patience: int = 2
    rollback_lookback: int = 3
    history_limit: int = 50

    # tag diversity
    overused_count: int = 3
    overused_share: float = 0.30
    dominant_count: int = 3
    dominant_share: float = 0.35
    tags_per_round: int = 1
    rare_tag_limit: int = 4
    tag_similarity: float = 0.92
    generation_attempts: int = 2
    tag_list_limit: int = 200
    prompt_tags: int = 500
    tag_group_limit: int = 3

    # generation requests
    model_id: str = "external-generator"
    temperature: float = 0.7
    cache_version: str = "dynamic_tags_v5"

    def exploration_slots(self) -> int:
        from math import ceil

        return max(1, ceil(self.batch_size * self.wide_variety_fraction))

    def focused_slots(self) -> int:
        return max(0, self.batch_size - self.exploration_slots())


DEFAULTS = Params()
