"""All queries of the library's own operators."""

from __future__ import annotations

from tideline.plans import daily_queries, flow_queries, place_queries, series_queries, stateful_queries, view_queries  # noqa: F401
from tideline.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "gate_flux_daily"


def queries() -> dict[str, Query]:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES
