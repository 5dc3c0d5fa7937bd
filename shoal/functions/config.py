"""Tunables of an analysis, compiled into literals."""

from __future__ import annotations

from dataclasses import dataclass

from shoal.functions.countries import BLOCKED
from shoal.functions.exprs import DAY_US


@dataclass(frozen=True)
class Config:
    """as_of and the *_since times are microseconds; as_of fixes the analysis time, so that runs can be repeated."""

    as_of: int
    young_days: int = 730
    campaign_since: int | None = None
    creation_window_days: int = 30
    burst_window_days: int = 7
    burst_background_days: int = 180
    burst_alpha: float = 1e-3
    botlike_threshold: float = 0.5
    fresh_signup_days: int = 60
    band_min_fraction: float = 0.6
    band_min_lift: float = 2.0
    min_cluster_size: int = 3
    cluster_flag_threshold: float = 0.5
    louvain_resolution: float = 1.0
    seed: int = 42
    #: Pairs of a cluster that overlap and copy shares are taken over, in order of members; None takes all.
    first_pairs: int | None = None
    blocked: tuple[str, ...] = BLOCKED

    @property
    def recent_since(self) -> int:
        return self.campaign_since if self.campaign_since is not None else self.as_of - self.young_days * DAY_US
