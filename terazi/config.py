"""Settings of the analyses; immutable, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass

from terazi.metadata import GROWTH_GROUPS, LOOKTHROUGH_GROUPS

#: Intervals of the named look-back periods.
LOOKBACKS = {"1m": 20, "3m": 60, "6m": 120, "1y": 240}


def intervals(lookback: str | int) -> int:
    """Intervals of a named or numeric look-back; ValueError for anything else."""
    n = LOOKBACKS.get(lookback, lookback) if isinstance(lookback, str) else lookback
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError(f"look-back {lookback!r}: give one of {', '.join(LOOKBACKS)} or a positive number of intervals")
    return n


@dataclass(frozen=True)
class LensConfig:
    """Thresholds of the universe analysis."""

    lookback: str | int = "1m"
    min_start_aum: float = 1_000_000.0
    neutral: float = 0.0005
    aum_edges: tuple[float, float, float] = (1e8, 1e9, 1e10)
    holder_edges: tuple[float, float, float] = (1e3, 1e4, 1e5)


@dataclass(frozen=True)
class StressConfig:
    """Thresholds of the stress signals."""

    min_aum: float = 1_000_000.0
    price_drop: float = -0.03
    heavy_outflow: float = -0.05
    outflow_lag_days: int = 2
    baseline_days: int = 20
    min_baseline_days: int = 10
    min_deviation: float = 0.005
    event_threshold: float = 4.0
    freeze_min_days: int = 5
    freeze_min_activity: float = 0.8
    freeze_min_history: int = 10
    history_days: int | None = 45
    turn_threshold: float = 0.20


@dataclass(frozen=True)
class ClassificationConfig:
    """Settings of the allocation classification."""

    feature_space: str = "broad"
    renormalize: bool = True
    transform: str = "none"
    k: int | None = None
    k_range: tuple[int, int] = (4, 16)
    random_state: int = 42
    n_init: int = 10
    min_funds_for_model: int = 40
    dominant_threshold: float = 60.0
    primary_threshold: float = 40.0
    lookthrough_penalty: bool = True
    low_confidence_threshold: float = 0.25
    sub_window_count: int = 4
    participation_tolerance: float = 1.0
    participation_min_coverage: float = 60.0
    risk_band_method: str = "fixed"
    risk_band_edges: tuple[float, float, float] = (10.0, 35.0, 65.0)
    currency_band_threshold: float = 60.0
    lookthrough_band_edges: tuple[float, float] = (5.0, 25.0)
    min_total: float = 90.0
    max_total: float = 105.0
    min_observations: int = 1
    growth_groups: tuple[str, ...] = GROWTH_GROUPS
    lookthrough_groups: tuple[str, ...] = LOOKTHROUGH_GROUPS

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.feature_space in ("broad", "detailed", "raw"), f"unknown feature space {self.feature_space!r}")
        need(self.transform in ("none", "hellinger"), f"unknown transform {self.transform!r}")
        need(self.risk_band_method in ("fixed", "quantile", "kmeans1d"), f"unknown risk band method {self.risk_band_method!r}")
        need(2 <= self.k_range[0] <= self.k_range[1], "k_range must ascend from 2 or more")
        need(self.k is None or self.k >= 2, "k must be 2 or more")
        need(self.sub_window_count >= 1, "sub_window_count must be 1 or more")
        need(0 <= self.dominant_threshold <= 100 and self.primary_threshold <= self.dominant_threshold, "thresholds must lie in 0..100, primary not above dominant")
        need(list(self.risk_band_edges) == sorted(set(self.risk_band_edges)), "risk band edges must ascend")
        need(self.lookthrough_band_edges[0] < self.lookthrough_band_edges[1], "look-through edges must ascend")
