"""Settings of the condensing plan."""

from __future__ import annotations

import math
from dataclasses import dataclass

from condenspark.functions.severity import protect_rank


@dataclass(frozen=True)
class Config:
    window: int = 15
    spike_multiplier: float = 8.0
    protect_multiplier: float = 3.0
    severity_protect: str = "ERROR"
    max_patterns: int = 10_000
    min_window_events: int = 5
    cooldown: float = 60.0
    bucket_seconds: int = 5
    alpha: float = 0.05
    min_baseline_samples: int = 3
    assumed_per_minute: float = 1.0
    min_bootstrap_events: int = 10

    def __post_init__(self):
        for name in ("window", "max_patterns", "min_window_events"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        for name in ("spike_multiplier", "protect_multiplier"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) > 1):
                raise ValueError(f"{name} must be a finite number above 1")
        if not self.cooldown >= 0:
            raise ValueError("cooldown must not be negative")
        protect_rank(self.severity_protect)

    @property
    def protect_rank(self) -> int:
        return protect_rank(self.severity_protect)

    @property
    def buckets(self) -> int:
        return max(1, max(self.bucket_seconds, self.window) // self.bucket_seconds)

    @property
    def window_seconds(self) -> int:
        return self.buckets * self.bucket_seconds
