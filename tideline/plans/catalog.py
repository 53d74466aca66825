"""The registry of queries and of their DuckDB twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "flagship_trend_metrics"


def load() -> None:
    """Registers all queries."""
    from tideline.plans import corpus, landing, market, panel, research, runs  # noqa: F401



