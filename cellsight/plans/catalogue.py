"""Every registered query of the engine with its SQL counterpart; names follow the operators they show."""

from __future__ import annotations

from cellsight.plans import queries_attribution, queries_models, queries_more, queries_tables

QUERIES = queries_tables.QUERIES | queries_attribution.QUERIES | queries_more.QUERIES | queries_models.QUERIES
ORACLES: dict[str, str] = queries_tables.ORACLES | queries_attribution.ORACLES | queries_more.ORACLES | queries_models.ORACLES
FLAGSHIP = queries_models.feature_assembly
