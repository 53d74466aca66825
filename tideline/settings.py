"""Settings as literals; they go into column expressions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Market:
    """Windows, risk limits and costs of the rule strategy. Defaults suit the small test tables."""

    periods_per_year: int = 2190
    latency_s: int = 30
    ema_fast: int = 10
    ema_slow: int = 40
    donchian_entry: int = 20
    donchian_exit: int = 10
    atr_window: int = 10
    volatility_window: int = 20
    volume_window: int = 20
    return_windows: tuple[int, ...] = (1, 2, 6, 12)
    volatility_windows: tuple[int, ...] = (6, 12, 24)
    max_volatility: float = 120.0
    target_volatility: float = 35.0
    max_exposure: float = 0.35
    min_exposure: float = 0.05
    fee_bps: float = 15.0
    slippage_bps: float = 10.0
    initial_cash: float = 10_000.0
    delay_bars: int = 1
    holding_bars: int = 1
    threshold_bps: float = 0.0

    @property
    def one_way(self) -> float:
        return (self.fee_bps + self.slippage_bps) / 10_000


@dataclass(frozen=True)
class Split:
    """Sizes of sealed folds, in rows."""

    train: int = 120
    calibration: int = 30
    validation: int = 30
    test: int = 30
    step: int = 30
    embargo: int = 1
