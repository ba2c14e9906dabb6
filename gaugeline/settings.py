"""Thresholds and limits, validated once and passed to every job."""

from __future__ import annotations

import hashlib
import os
from dataclasses import asdict, dataclass, fields

from gaugeline import fixed_values as V


@dataclass(frozen=True)
class Settings:
    # judgement thresholds
    missing_medium_pct: float = 5.0
    missing_high_pct: float = 30.0
    near_constant_ratio: float = 0.95
    high_cardinality_ratio: float = 0.90
    high_cardinality_min_non_null: int = 20
    correlation_threshold: float = 0.95
    # scope limits; 0 means none, so results are whole unless a limit is asked for
    max_numeric_columns: int = 0
    max_profile_columns: int = 0
    max_duplicate_columns: int = 0
    max_schema_columns: int = 0
    max_classes: int = 0
    max_label_bytes: int = 0
    max_tool_calls: int = 0
    max_tool_attempts: int = 0
    max_local_compute_seconds: float = 0.0
    max_upload_mb: int = 0
    # size of a shortened observation (:func:`gaugeline.plans.evidence.bound_observations`)
    max_findings_per_tool: int = 20
    max_observation_bytes: int = 16384
    # classes that an observation on the driver lists, 0 for all; it tells how many more there are
    max_listed_classes: int = 0
    # 0 switches the quartile admission rule off: the quantile job spills, so it
    # does not need the rule; set a byte budget to reproduce the skip status
    max_quantile_bytes: int = 0
    # physical choices; none of them changes a result
    duplicate_hash_min_rows: int = 500_000
    broadcast_max_rows: int = 1_000_000
    long_text_bytes: int = 256
    quantile_accuracy: int = 10_000
    quantile_finish_rows: int = 2_000_000

    def __post_init__(self) -> None:
        positive = (
            "max_findings_per_tool broadcast_max_rows quantile_accuracy "
            "quantile_finish_rows"
        ).split()
        bad = [name for name in positive if getattr(self, name) < 1]
        if bad:
            raise ValueError("Settings must be positive: " + ", ".join(bad))
        if self.max_observation_bytes < 2048:
            raise ValueError("max_observation_bytes must be at least 2048")
        negative = [f.name for f in fields(self) if f.name.startswith("max_") and getattr(self, f.name) < 0]
        if negative:
            raise ValueError("Limits must not be negative: " + ", ".join(negative))
        if not 0 <= self.missing_medium_pct < self.missing_high_pct <= 100:
            raise ValueError("Missing-value thresholds must be increasing percentages")
        for name in ("near_constant_ratio", "high_cardinality_ratio", "correlation_threshold"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in (0, 1]")

    @classmethod
    def interactive(cls, **changes) -> "Settings":
        """Settings with the limits of an interactive session on one machine."""
        return cls(**(V.INTERACTIVE_LIMITS | changes))

    @classmethod
    def from_env(cls, environ=None) -> "Settings":
        """Read any field from an environment variable of the same upper-case name."""
        source = os.environ if environ is None else environ
        kinds = {"float": float, "int": int}
        found = {
            f.name: kinds[f.type](source[f.name.upper()])
            for f in fields(cls)
            if f.name.upper() in source
        }
        return cls(**found)

    def key(self) -> str:
        """Digest of every field, used to tell stored results apart."""
        text = ";".join(f"{k}={v!r}" for k, v in sorted(asdict(self).items()))
        return hashlib.sha256(text.encode()).hexdigest()[:16]


def within(value: float, limit: float) -> bool:
    return not limit or value <= limit


DEFAULTS = Settings()
