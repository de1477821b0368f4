"""The registered queries and their DuckDB counterparts, collected by name."""

from __future__ import annotations

from factloom.plans import facts, graphs, ledgers, prose, reports, scores, views, words, writes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (words, facts, ledgers, graphs, scores, reports, writes, prose, views):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
