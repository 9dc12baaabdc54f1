"""Providers, weights, thresholds and options of date resolution."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

# Provider order and default weights, thresholds of the anomaly rules.
PROVIDERS = ("filename", "exif", "media", "xmp", "takeout", "system", "filesystem")
DEFAULT_WEIGHTS = {"xmp": 42, "exif": 40, "media": 40, "takeout": 38, "system": 36, "filename": 30, "filesystem": 10}
MIN_WEIGHT, MAX_WEIGHT = 0, 100
FLAG_PENALTY, CONSENSUS_BONUS, CONSENSUS_HOURS = 1000, 25, 24
EPOCH_SECONDS, WRITE_HOURS, SPREAD_DAYS, MAX_ZONE_HOURS = 60, 48, 180, 14
RUN_GAP_DAYS, DRIFT_DAYS, CLUSTER_MIN, SEQUENCE_MIN, NEIGHBOUR_MIN = 30, 730, 5, 5, 5
BURST_SECONDS, BURST_BITS = 10, 10
HARD_FLAGS = ("camera_epoch", "future_date", "taken_after_file_write", "clock_reset_run", "identical_timestamp_cluster", "sequence_outlier", "far_from_neighbours")
SOFT_FLAGS, NOTE_FLAGS = ("provider_spread",), ("timezone_shift",)
CROSS_FLAGS = ("clock_reset_run", "identical_timestamp_cluster", "sequence_outlier", "far_from_neighbours")

#: What becomes of a file that is copied, as journals say it.
OUTCOMES = ("copied", "duplicate", "already_present", "failed")
#: Names that are tried at a destination.
MAX_VARIANTS = 10_000

#: The clock of date rules is always an argument; queries use this one.
NOW = datetime(2001, 1, 1)


@dataclass(frozen=True)
class DetectOptions:
    """strategy: smart, oldest or priority. providers: the user's order. weights: override the defaults, clamped to 0..100."""

    strategy: str = "smart"
    providers: tuple[str, ...] = PROVIDERS
    weights: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.strategy not in ("smart", "oldest", "priority"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if unknown := {*self.providers, *self.weights} - {*PROVIDERS}:
            raise ValueError(f"unknown providers {sorted(unknown)}")

    def weight(self, provider: str) -> int:
        own = self.weights.get(provider)
        return DEFAULT_WEIGHTS[provider] if own is None else max(MIN_WEIGHT, min(MAX_WEIGHT, own))
