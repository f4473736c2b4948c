"""Settings shared by the market jobs."""

from __future__ import annotations

from dataclasses import dataclass

FACTORS = ("stock_momentum", "sector_momentum", "vol_regime", "vix_regime", "rate_trend", "volume_regime")


@dataclass(frozen=True)
class Config:
    horizon: int = 21
    factors: tuple[str, ...] = ("stock_momentum", "sector_momentum", "vix_regime")
    momentum_lookback: int = 63
    vol_window: int = 21
    regime_window: int = 252
    edges: tuple[float, ...] = (-0.10, -0.05, -0.02, 0.0, 0.02, 0.05, 0.10)
    prior_strength: float = 20.0
    min_train_years: float = 3
    refit_every: int = 21
    holdout_fraction: float = 0.2
    relative: bool = False

    def __post_init__(self):
        if unknown := set(self.factors) - set(FACTORS):
            raise ValueError(f"unknown factors: {sorted(unknown)}")
        if list(self.edges) != sorted(set(self.edges)):
            raise ValueError("edges must increase")
