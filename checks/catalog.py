"""All checked queries."""
from __future__ import annotations

from checks import indicators, market_data, portfolio, strategies, streams, trading  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
