"""Validated parameters shared by every operator."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

MAX_SAFE_INTEGER = 2**53 - 1

# Caps on requests.
MAX_QUERY_CHARS = 512
MAX_RETRIEVAL_BYTES = 32 * 1024
MAX_SEARCH_RESULTS = 20
DEFAULT_RETRIEVAL_BYTES = 8 * 1024
DEFAULT_SEARCH_RESULTS = 10
MAX_TOOL_NAME_CHARS = 128

INJECTION_MODES = ("off", "once-per-user-turn", "every-llm-call")

_COUNTS = (
    "archive_threshold_bytes",
    "receipt_max_bytes",
    "hot_observation_count",
    "project_quota_bytes",
    "retention_days",
    "map_context_max_bytes",
    "map_debounce_ms",
    "map_generation_retention",
    "map_quota_bytes",
)


@dataclass(frozen=True)
class Params:
    archive_threshold_bytes: int = 16 * 1024
    receipt_max_bytes: int = 4 * 1024
    hot_observation_count: int = 6
    soft_context_ratio: float = 0.75
    target_context_ratio: float = 0.6
    project_quota_bytes: int = 512 * 1024 * 1024
    retention_days: int = 30
    map_context_max_bytes: int = 6 * 1024
    map_debounce_ms: int = 300
    map_generation_retention: int = 3
    map_quota_bytes: int = 128 * 1024 * 1024
    map_exclude_patterns: tuple[str, ...] = ()
    map_injection_mode: str = "once-per-user-turn"

    def __post_init__(self) -> None:
        for name in _COUNTS:
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not 0 < value <= MAX_SAFE_INTEGER:
                raise ValueError(f"{name} must be a positive integer")
        for name in ("soft_context_ratio", "target_context_ratio"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 < value < 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.target_context_ratio >= self.soft_context_ratio:
            raise ValueError("target_context_ratio must be below soft_context_ratio")
        for name in ("receipt_max_bytes", "map_context_max_bytes"):
            if getattr(self, name) < 512:
                raise ValueError(f"{name} must be at least 512")
        patterns = self.map_exclude_patterns
        if isinstance(patterns, str) or any(not isinstance(p, str) or not p.strip() for p in patterns):
            raise ValueError("map_exclude_patterns must hold non-blank strings")
        object.__setattr__(self, "map_exclude_patterns", tuple(patterns))
        if self.map_injection_mode not in INJECTION_MODES:
            raise ValueError(f"map_injection_mode must be one of {', '.join(INJECTION_MODES)}")

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> "Params":
        """Build from a mapping; a key that is no parameter is an error."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameter: {', '.join(sorted(unknown))}")
        return cls(**values)
