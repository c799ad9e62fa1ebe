"""All queries of the landscape operators by name, and their SQL."""

from __future__ import annotations

from .plans import analysis, criteria, networks, places, records, terrain, views

_MODULES = (terrain, criteria, networks, views, analysis, places, records)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "suitability_weighted"
