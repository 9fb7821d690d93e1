"""All queries of the package by name, with their SQL."""

from __future__ import annotations

from lodestream.plans import archives, attribution, budgets, control, discovery, enrichment, events, extensions, fleet, ladder, records, reports, settings, state, text  # noqa: F401  they register their queries
from lodestream.plans.registry import ORACLES, QUERIES

FLAGSHIP = "scrub_ledger_by_source"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
