"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from gatework.plans import assessing, documents, enriching, gating, reporting, shifting

QUERIES: dict = {}
ORACLES: dict = {}
for module in (gating, enriching, assessing, reporting, shifting, documents):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
